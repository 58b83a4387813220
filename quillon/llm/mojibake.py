"""Text decoded with the wrong encoding: garbled forms of the corpus's own words, found by hash join and put right.

Every distinct clean word with a character beyond ASCII, and every distinct such character of clean words, is turned into
the forms it takes under all chains of wrong decoding below; a word is clean if its whole token can be read as it stands.
The pieces of the documents' tokens are joined to this table by equality; a hit names the original and the chain. Single
characters count only with forms of two or more characters; forms that are but another letter (one single-byte code page
read as another, or lost bytes) count for whole words only: that the corpus itself uses the original is what verifies it.
Where the form can't be read as it stands (letters of two scripts, a capital behind a small letter, signs between
letters) and the original is a word without signs that can, this is enough; otherwise the original must be in more
distinct texts than the form, so that copies of a text weigh nothing (a text counts once for each of its tokens with the
word). Near copies with other texts still weigh where both can be read (ń for ñ). Forms whose garbled character is a
blank or invisible (`est` and a no-break space for está) aren't told from ordinary spacing and don't count.
Words of fewer than three letters count only in forms that can't be read (lа for là, with a Cyrillic а), as many others
are words or formulas of their own (σt for åt); single letters as words never. Words have no greatest length: above 24
characters a UTF-8 form is left out of the table only where each of its garbled characters is in it by itself, which
finds and restores the same words.
The replacement character U+FFFD is in the table as the form of every lost original; it is reported, and restored only
where a whole word tells what was lost.

Character references are read as the characters they stand for. A sequence that stands alone between double quotation
marks, in a sentence that speaks of such errors, is an example somebody quotes, not a case.

Defined results: null texts are no case; a text may hold both garbled and sound parts, only the former change; texts of
pure ASCII without references are never touched; repeated doc_ids are reported once by found_documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import free, join_hot, join_small, settle, wide

_REF = r"&(?:#[0-9]{2,7}|#[xX][0-9A-Fa-f]{2,6}|[A-Za-z][A-Za-z0-9]{1,7});"
_HIGH = rf"(?:[^\x00-\x7F]|{_REF})"
TOKEN = rf"(?<![0-9A-Za-z])[0-9A-Za-z]*+{_HIGH}(?:[0-9A-Za-z]|{_HIGH})*+"
QUOTED = rf"(?:\"|&quot;|“|„)(?:(?![“”„]){_HIGH})++(?:\"|&quot;|”|“)"
#: What sentences about such errors say, in the corpus's languages, and where sentences end.
TALK = (
    "(?i)encod|decod|charset|code ?page|utf-?8|latin-?1|unicode|mojibake|garbl|mangl|in place of|instead of|quoted|bug report|character|"
    "kodier|zeichen|anstelle|statt |encodage|décod|au lieu d|à la place d|caractère|codifica|en lugar d|en vez d|carácter|caracteres"
)
SENTENCE = r"(?<=[.!?…\n])\s+"
#: Code pages that texts in UTF-8 are taken for, and pairs of single-byte code pages taken for each other.
PAGES = ("cp1252", "latin_1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "iso8859_15", "koi8_r")
SWAPS = (("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1250"), ("cp1252", "koi8_r"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1251", "cp1252"))
#: Characters of the longest form that one character takes under the chains.
LONGEST = 12


def _read(data: bytes, page: str, undefined: str) -> str:
    """Decode; bytes without a character become the control character of their number, U+FFFD, or nothing."""
    out = data.decode(page, "surrogateescape")
    if undefined == "control":
        return re.sub("[\udc80-\udcff]", lambda m: chr(ord(m[0]) - 0xDC00), out)
    return re.sub("[\udc80-\udcff\x80-\x9f]", "�" if undefined == "mark" else "", out)


def _chains() -> list[tuple[str, bool, Callable[[str], str]]]:
    """(name, whether it may be applied to single characters, garble)."""
    out: list[tuple[str, bool, Callable[[str], str]]] = []
    for page in PAGES:
        for undefined in ("control", "mark", "drop") if page in ("cp1252", "latin_1") else ("control",):
            out.append((f"utf-8>{page}/{undefined}", True, lambda s, p=page, u=undefined: _read(s.encode(), p, u)))
    twice = [(a, b) for a in PAGES[:2] for b in PAGES[:2]] + [(p, p) for p in PAGES[2:6]]
    for a, b in twice:
        for undefined in ("control", "mark", "drop") if b in PAGES[:2] else ("control",):
            out.append((f"utf-8>{a}>utf-8>{b}/{undefined}", True, lambda s, a=a, b=b, u=undefined: _read(_read(s.encode(), a, "control").encode(), b, u)))
    for a, b in SWAPS:
        out.append((f"{a}>{b}", False, lambda s, a=a, b=b: s.encode(a).decode(b)))
    for a in ("cp1252", "mac_roman"):
        out.append((f"{a}>utf-8", False, lambda s, a=a: s.encode(a).decode("utf-8", "replace")))
    return out


CHAINS = _chains()
#: The characters that bytes beyond ASCII become; a garbled form has no others, and begins with what a lead byte becomes.
HIGH = frozenset(_read(bytes([b]), p, u) for p in PAGES for b in range(0x80, 0x100) for u in ("control", "mark", "drop"))
LEAD = frozenset(_read(bytes([b]), p, "control") for p in PAGES for b in range(0xC2, 0xF5))
_WORD = re.compile(r"(?:[^\W_]|[̀-ͯ’'])+")
_RUN = re.compile(r"[^\x00-\x7f]+")


def words_of(token: str) -> set[str]:
    """The token and its words that hold a character beyond ASCII."""
    return {w for w in (token, *_WORD.findall(token)) if not w.isascii()}


@lru_cache(maxsize=100_000)
def _own(chain: int, c: str) -> int:
    """Length of a character's own form."""
    return len(CHAINS[chain][2](c))


def forms(word: str) -> dict[str, str]:
    """Garbled form to chain. Of several chains with one result the first is named."""
    out: dict[str, str] = {}
    single = len(word) == 1
    for i, (name, chars, garble) in enumerate(CHAINS):
        if single and not chars:
            continue
        if chars and len(word) > 2 * LONGEST and all(_own(i, c) > 1 for c in set(word) if ord(c) > 127):
            continue  # the characters' own forms are in the table
        try:
            g = garble(word)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        if g == word or g.isascii() or single and len(g) < 2:
            continue
        if not chars and any(unicodedata.category(c) in ("Zs", "Cf") for c in g if ord(c) > 127):
            continue
        out.setdefault(g, name)
    return out


#: Categories of characters that don't stand between two letters of a word; punctuation may.
_SIGNS = ("Sm", "So", "Sk", "Sc", "No")


def readable(word: str) -> bool:
    """False if no writer means the word as it stands. U+FFFD says nothing here."""
    letters = [c for c in word if c.isalpha()]
    scripts = {n for c in letters if (n := unicodedata.name(c, "").split(" ")[0]) in ("LATIN", "CYRILLIC", "GREEK")}
    if {"LATIN", "CYRILLIC"} <= scripts or len(scripts) > 1 and len(letters) > 2:  # two letters may be a formula
        return False
    if len(letters) > 2 and scripts == {"LATIN"} and not any(c.isascii() for c in letters):
        return False
    for a, b, c in zip(word, word[1:], f"{word[2:]} "):
        if a.islower() and b.isupper() and not b.isascii():
            return False
        if len(letters) > 2 and a.isalpha() and c.isalpha() and (b in "ªº" or unicodedata.category(b) in _SIGNS) and b != "�":
            return False
    return True


def pieces(token: str) -> set[str]:
    """What is looked up of a token: its words, and the substrings of its runs beyond ASCII that one character can become."""
    out = {w for w in words_of(token) if HIGH.issuperset(c for c in w if ord(c) > 127)}
    if "�" in token:
        out.add("�")
    for m in _RUN.finditer(token):
        run = m.group()
        for i, c in enumerate(run):
            if c in LEAD:
                for j in range(i + 1, min(len(run), i + LONGEST)):
                    if run[j] not in HIGH:
                        break
                    out.add(run[i : j + 1])
    return out


def restore(token: str, hits: dict[str, str]) -> str:
    """Replace the longest hits first, from the left."""
    if token in hits:
        return hits[token]
    parts = sorted((h for h in hits if h in token), key=len, reverse=True)
    return re.sub("|".join(map(re.escape, parts)), lambda m: hits[m[0]], token) if parts else token


def _batched(fn: Callable[[tuple], Iterator[tuple]], types: list[tuple[str, pa.DataType]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, types)], names=[n for n, _ in types])

        rows: list[tuple] = []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                rows += fn(row)
                if len(rows) > 5_000:
                    yield out()
                    rows = []
        yield out()

    return run


def _split_token(row: tuple) -> Iterator[tuple]:
    code, token, docs = row
    clean = html.unescape(token)
    if clean.isascii():
        return
    if "�" not in clean and readable(clean):
        for w in words_of(clean):
            yield code, docs, w, "word"
        for c in {c for c in clean if ord(c) > 127}:
            yield code, docs, c, "char"
    if "�" in clean:
        yield code, docs, "�", "char"
    for p in pieces(clean):
        yield code, docs, p, "piece"


def _forms_row(row: tuple) -> Iterator[tuple]:
    word, docs = row
    if word == "�":
        yield word, docs, 1, word, "lost"
    elif any(c.isalpha() for c in word) or len(word) == 1:
        sound = readable(word) * (2 if len(word) == 1 or _WORD.fullmatch(word) else 1)
        for g, chain in forms(word).items():
            yield word, docs, sound, g, chain


def _read_row(row: tuple) -> Iterator[tuple]:
    piece, original, sound, in_docs, docs, chain = row
    lost = "�" in piece
    bad = not lost and not readable(piece)
    short = sum(c.isalpha() for c in original) < 3  # many of their forms are other words or formulas: åt, σt
    if len(original) == 1 or (sound == 2 and bad) or (not short and in_docs > docs and (sound or bad or lost)):
        yield piece, original, chain, docs


def _restore_row(row: tuple) -> Iterator[tuple]:
    token, hits = row
    clean = html.unescape(token)
    out = restore(clean, {h["piece"]: h["original"] for h in hits})
    again = {h["piece"]: h["original"] for h in hits}
    for _ in range(2):  # what was garbled twice with one step known
        more = restore(out, again)
        if more == out:
            break
        out = more
    yield token, out, next((h["chain"] for h in hits if h["original"] != h["piece"]), "lost")


def _string(*names: str) -> list[tuple[str, pa.DataType]]:
    return [(n, pa.int64() if n in ("docs", "code", "sound", "uses") else pa.string()) for n in names]


def _without_examples(text: Column) -> Column:
    """The text without what its sentences about such errors quote."""
    plain = F.transform(F.split(text, SENTENCE), lambda x: F.when(x.rlike(TALK), F.regexp_replace(x, QUOTED, " ")).otherwise(x))
    return F.when(text.rlike(QUOTED), F.array_join(plain, "\n")).otherwise(text)


def garbled_tokens(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, garbled). occurrences: doc_id, token (with a character beyond ASCII or a reference), each once.
    garbled: token, restored (may hold U+FFFD where the original is lost), chain."""
    spark = documents.sparkSession
    text = _without_examples(F.col("text"))
    seen = documents.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("token"), F.xxhash64("text").alias("content"))
    seen = settle(seen)
    texts = seen.select("token", "content").distinct()  # copies of a text count once
    tokens = settle(texts.groupBy("token").agg(F.count("*").alias("docs")).withColumn("code", F.monotonically_increasing_id()).select("code", "token", "docs"))
    parts = settle(tokens.mapInArrow(_batched(_split_token, _string("code", "docs", "part", "kind")), "code long, docs long, part string, kind string"))
    units = parts.where("kind <> 'piece'").groupBy("part").agg(F.sum("docs").alias("docs"))
    # few bytes, but much work; by another key than the aggregation's, whose partitions AQE would coalesce
    units = units.repartition(wide(spark), F.xxhash64("part"))
    table = settle(units.mapInArrow(_batched(_forms_row, _string("original", "docs", "sound", "piece", "chain")), "original string, docs long, sound long, piece string, chain string"))
    # one original for each garbled form: of the words that can be read (beside lost characters of all), the one that most texts use
    rank = F.when(F.col("piece").contains("�"), F.least("sound", F.lit(1))).otherwise(F.col("sound")).alias("rank")
    best = table.groupBy("piece").agg(F.max(F.struct(rank, "docs", "sound", "original", "chain")).alias("b")).select("piece", F.col("b.original").alias("original"), F.col("b.sound").alias("sound"), F.col("b.docs").alias("in_docs"), F.col("b.chain").alias("chain"))
    best = settle(best)
    use = parts.where("kind = 'piece'").groupBy("part").agg(F.sum("docs").alias("docs")).withColumnRenamed("part", "piece")
    known = best.join(use, "piece").select("piece", "original", "sound", "in_docs", "docs", "chain")
    known = settle(known.mapInArrow(_batched(_read_row, _string("piece", "original", "chain", "uses")), "piece string, original string, chain string, uses long"))
    hits = join_hot(parts.where("kind = 'piece'").select("code", F.col("part").alias("piece")), known, "piece", "uses", F.col("code"))
    hits = settle(hits.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("piece", "original", "chain"))).alias("hits")))
    hits = join_small(tokens, hits, "code").select("token", "hits")
    found = hits.mapInArrow(_batched(_restore_row, _string("token", "restored", "chain")), "token string, restored string, chain string")
    garbled = settle(found.where("restored <> token or chain = 'lost'"))
    free(tokens, parts, table, best, known)
    return seen.drop("content"), garbled


def found_documents(documents: DataFrame) -> DataFrame:
    """doc_id of every document with at least one garbled sequence."""
    seen, garbled = garbled_tokens(documents)
    return join_small(seen, garbled.select("token"), "token", "left_semi").select("doc_id").distinct()


def repaired(documents: DataFrame) -> DataFrame:
    """doc_id, garbled (distinct garbled tokens), lost (those not restored in full), text as restored."""
    seen, garbled = garbled_tokens(documents)
    mine = join_small(seen, garbled, "token").groupBy("doc_id").agg(F.collect_list(F.struct("token", "restored")).alias("fix"))
    mine = settle(mine)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def fix(row: tuple) -> Iterator[tuple]:
        doc, text, changes = row
        to = {c["token"]: c["restored"] for c in changes}
        one = lambda x: re.sub(f"{QUOTED}|{TOKEN}" if re.search(TALK, x) else TOKEN, lambda m: to.get(m[0], m[0]), x)
        parts = re.split(f"({SENTENCE})", text) if re.search(QUOTED, text) else [text]
        yield doc, len(to), sum("�" in r for r in to.values()), "".join(map(one, parts)) if len(parts) > 1 else re.sub(TOKEN, lambda m: to.get(m[0], m[0]), text)

    types = [("doc_id", pa.int64()), ("garbled", pa.int32()), ("lost", pa.int32()), ("text", pa.string())]
    return join_small(texts, mine, "doc_id").select("doc_id", "text", "fix").mapInArrow(_batched(fix, types), "doc_id long, garbled int, lost int, text string")
