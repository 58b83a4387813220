"""Duplicates hidden by formatting: dictionary encoding of values, records as sorted integer tuples.

Two texts are one record if the same sequence of letters and digits is left when all else is dropped and case is
ignored, or if both consist of at least three fields `Name: value` and nothing else (parted by line breaks, semicolons,
vertical bars or commas, or a flat JSON object) and have the same fields in any order.

Every text is a record of one value, itself, and if it consists of fields also a record of these. All values, texts and
fields alike, go through one dictionary: each distinct value is canonicalised once, and each canonical form gets an
integer. A record is the sorted tuple of its integers; tuples are grouped. Since a text can be equal to one by its
sequence and to another by its fields, classes that share a document are joined as connected components.

Defined results: null texts and texts without any letter or digit belong to no record. Repeated doc_ids count once.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.components import connected_components
from quillon.session import free, join_hot, join_small, settle

#: Fixed patterns of the statement: what parts fields, tried in this order, and how a field begins.
SEPARATORS = ("\\r?\\n", ";", "\\|", ",", "[\\r\\n;|]", "[\\r\\n;|,]")
FIELD = "^\\s*[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M} _./-]*\\s*:"


def canonical(text: Column) -> Column:
    """Letters and digits only, without case; upper before lower, so that ß and SS agree. (The removal stands between
    the two, since the optimizer drops an upper directly inside a lower.)"""
    return F.lower(F.regexp_replace(F.upper(text), "[^\\p{L}\\p{N}]+", ""))


def fields_of(text: Column) -> Column:
    """The raw fields of a text that consists of fields, else null."""
    found = []
    for sep in SEPARATORS:
        parts = F.filter(F.split(text, sep), lambda p: F.length(F.trim(p)) > 0)
        found.append(F.when((F.size(parts) >= 3) & F.forall(parts, lambda p: p.rlike(FIELD)), parts))
    entries = F.map_entries(F.from_json(text, "map<string,string>", {"allowUnquotedControlChars": "true"}))
    flat = F.when((F.size(entries) >= 3) & F.forall(entries, lambda e: ~F.coalesce(F.ltrim(e["value"]), F.lit("")).rlike("^[\\[{]")), F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))))
    plain = F.when(text.rlike(FIELD), F.coalesce(*found))  # the first field begins where the text does
    return F.when(text.rlike("^\\s*\\{"), flat).otherwise(plain)


def _classes(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, members). all: doc_id of every document with a letter or digit. members: doc_id, keep_id of those whose
    record has several documents."""
    texts = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    fields = F.coalesce(fields_of(F.col("text")), F.array().cast("array<string>"))
    values = texts.select("doc_id", F.posexplode(F.concat(F.array("text"), fields)).alias("pos", "raw"))
    values = settle(values.withColumn("key", F.unhex(F.md5("raw"))))

    # dictionary: distinct raw value -> canonical form -> integer
    distinct = values.groupBy("key", "raw").agg(F.count("*").alias("n")).select("key", "n", canonical(F.col("raw")).alias("c"))
    distinct = settle(distinct.where("c <> ''").select("key", "n", F.unhex(F.md5("c")).alias("value")))
    codes = settle(distinct.groupBy("value").agg(F.sum("n").alias("uses")).withColumn("code", F.monotonically_increasing_id()))
    coded = settle(distinct.join(codes, "value").select("key", "code", "n", "uses"))
    cells = settle(join_hot(values.select("doc_id", "pos", "key"), coded, "key", "n", F.col("doc_id")).select("doc_id", "pos", "code", "uses"))
    free(values, distinct, codes, coded)

    whole = cells.where("pos = 0 and uses > 1").select("doc_id", F.array("code").alias("tuple"))
    records = cells.where("pos > 0").groupBy("doc_id").agg(F.sort_array(F.collect_list("code")).alias("tuple"))
    tuples = settle(whole.unionByName(records))
    same = settle(tuples.groupBy("tuple").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    classes = join_hot(tuples, same, "tuple", "n", F.col("doc_id")).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    classes = settle(classes)
    free(tuples, same)
    # a document of two classes links them
    labels = settle(connected_components(classes.where("a <> b").select("a", "b")))
    members = join_small(classes.select("doc_id", F.col("a").alias("node")), labels, "node", "left").select("doc_id", F.coalesce("component", "node").alias("keep_id"))
    return cells.where("pos = 0").select("doc_id"), members


def further_copies(documents: DataFrame) -> DataFrame:
    """keep_id, doc_id: one row per copy beyond the first of each record; keep_id is the smallest doc_id of the record."""
    return _classes(documents)[1].where("doc_id <> keep_id").select("keep_id", "doc_id").distinct()


def records(documents: DataFrame) -> DataFrame:
    """keep_id, copies: one row per record with the number of its documents."""
    everything, members = _classes(documents)
    several = members.groupBy("keep_id").agg(F.countDistinct("doc_id").alias("copies"))
    single = everything.join(members, "doc_id", "left_anti").select(F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("copies")).distinct()
    return several.unionByName(single)
