"""Spelling variants grouped by letter-parity bands.

Words are counted over all texts: each batch is counted for itself, and only its distinct words are exchanged.
A word's mask has a bit for each letter, set if the word holds the letter an odd number of times.
One inserted or deleted letter flips one bit, one replaced letter two, so of three bands of the mask
one is equal in two words that are one edit apart.  Equal bands are joined, and pairs are verified.

A band of nine letters has few values, and its buckets would grow with the vocabulary.  So they are parted by
two more things that near words share: the length of the shorter word, and the letters before or those after the
middle of it, as one edit leaves one of these halves alone.  Each word is a dozen rows, whatever its
bucket; of a bucket only pairs are joined whose masks differ by two bits at most, and each
pair is verified exactly, on code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, drop, small, tidy

#: Words that matter: code points, and occurrences overall.
LENGTH, OCCURRENCES = 6, 5
#: One run in so many has a letter deleted.
NOISE = 199
#: A form is so many times as frequent.
RATIO = 5
BANDS = 3
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
#: Code points of a text that are looked through at once.
PIECE = 1 << 20


def _runs(text: str, run: re.Pattern) -> Iterator[list[str]]:
    """Maximal runs of letters, from pieces of the text that end where a run ends."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if (inside := run.match(text, end - 1)) is not None:
            end = inside.end()
        yield run.findall(text, at, end)
        at = end


def word_counts(length: int, noise: int):
    """Words of a batch with their occurrences in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = re.compile("[A-Za-zÀ-ÿ]+")
        for batch in batches:
            count: Counter[str] = Counter()
            texts = batch.column("text").cast(pa.binary())
            for doc_id, cell in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                mine: Counter[str] = Counter()
                for found in _runs((cell.as_py() or b"").translate(_LOWER).decode(), letters):
                    mine.update(found)
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in mine.items():
                    if len(word) >= length:
                        h = zlib.crc32(word.encode(), start)
                        if h % noise == 0:
                            k = h % len(word)
                            word = word[:k] + word[k + 1 :]
                            if len(word) < length:
                                continue
                        count[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return run


def vocabulary(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, noise: int = NOISE) -> DataFrame:
    """(word, n): words of ``length`` code points or more, found ``occurrences`` times or more."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(tidy(word_counts(length, noise)), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= occurrences)


def _bands(word: Column) -> list[Column]:
    """The mask in three parts of at most 30 bits: letter k of the alphabet is bit k div 3 of band k mod 3."""
    def code(c: Column) -> Column:
        return F.when(F.ascii(c) < 0xC0, F.ascii(c) - 0x61).otherwise(F.ascii(c) - 0xC0 + 26)

    def band(b: int) -> Column:
        mine = F.filter(F.transform(F.split(word, ""), code), lambda k: k % BANDS == b)
        bit = F.transform(mine, lambda k: F.call_function("shiftleft", F.lit(1), F.floor(k / BANDS).cast("int")))
        return F.aggregate(bit, F.lit(0), lambda m, x: m.bitwiseXOR(x))

    return [band(b) for b in range(BANDS)]


def _keys(word: Column, size: Column, bands: list[Column]) -> Column:
    """(key, longer) for each band, role and half: ``longer`` is the role of the word with the letter that the other lacks."""
    out = []
    for longer in (False, True):
        short = size - 1 if longer else size
        half = F.floor(short / 2).cast("int")
        halves = (F.substring(word, F.lit(1), half), F.substring(word, half + (2 if longer else 1), size))
        for side, text in enumerate(halves):
            for b, band in enumerate(bands):
                key = F.xxhash64(F.lit(side), F.lit(b), short, band, text)
                out.append(F.struct(key.alias("key"), F.lit(longer).alias("longer")))
    return F.array(*out)


def near_words(words: DataFrame) -> DataFrame:
    """(a, b): pairs of ``words`` (``word``, distinct) that one inserted, deleted or replaced code point parts, each pair both ways.

    Words are of a to z and U+00C0 to U+00FF.
    """
    size = F.length("word")
    rows = words.select("word", size.alias("size"), *[x.alias(f"m{b}") for b, x in enumerate(_bands(F.col("word")))])
    rows = cut(rows, "masks")  # the masks are read, not computed, by the steps below
    masks = [F.col(f"m{b}") for b in range(BANDS)]
    keyed = rows.select("word", *masks, F.explode(_keys(F.col("word"), F.col("size"), masks)).alias("x"))
    keyed = keyed.select("word", *masks, F.col("x.key").alias("key"), F.col("x.longer").alias("longer"))
    left = keyed.filter("not longer").select("key", F.col("word").alias("a"), *[F.col(f"m{b}").alias(f"a{b}") for b in range(BANDS)])
    right = keyed.select("key", F.col("word").alias("b"), "longer", *[F.col(f"m{b}").alias(f"b{b}") for b in range(BANDS)])
    flipped = sum((F.bit_count(F.col(f"a{b}").bitwiseXOR(F.col(f"b{b}"))) for b in range(BANDS)), F.lit(0))
    found = left.join(right, "key").filter((F.col("longer") | (F.col("a") < F.col("b"))) & (flipped <= 2))
    found = found.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()
    found = cut(found, "near")
    drop(rows)
    return found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of a vocabulary (``word``, distinct, and ``n``).

    The form is the near word of the largest n (of ties the least by code points) if that is at least ``ratio`` times the word's own;
    the root is where forms lead to.  As n grows by every step, they lead to an end.
    """
    words = cut(words, "words")
    n_bytes = words.agg(F.sum(F.octet_length("word") + 32)).first()[0] or 0
    near = near_words(words)
    other = words.select(F.col("word").alias("b"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("b").alias("word"))).alias("best")
    best = near.join(small(other, n_bytes), "b").groupBy("a").agg(F.count("*").alias("n_near"), best)
    rows = words.join(best.withColumnRenamed("a", "word"), "word", "left")
    far = -F.col("best.order") >= ratio * F.col("n")
    rows = rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("best.word")).alias("form"), F.when(far, -F.col("best.order")).alias("form_n"),
    )
    rows = cut(rows, "forms")
    drop(near, words)
    roots = cut(rows.filter("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:  # each round doubles the steps that were followed
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        size = roots.agg(F.sum(F.octet_length("word") + F.octet_length("root") + 32)).first()[0] or 0
        after = cut(roots.join(small(onward, size), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        drop(roots)
        roots = after.drop("moved")
        if after.filter("moved").isEmpty():
            break
    size = roots.agg(F.sum(F.octet_length("word") + F.octet_length("root") + 32)).first()[0] or 0
    out = rows.join(small(roots, size), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(
    docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, noise: int = NOISE, ratio: int = RATIO
) -> DataFrame:
    """Words of all texts with their near words, forms and roots (see ``variants``).

    A null or empty text has no words; a null id reads as an empty one in the hash that decides on deletions; rows that repeat count
    as often as they come; columns other than ``doc_id`` and ``text`` aren't read; an empty table has no words.
    """
    return variants(vocabulary(docs, length, occurrences, noise), ratio)


def op12_spelling(docs: DataFrame) -> DataFrame:
    return spelling_variants(docs)


def oracle() -> str:
    """Near words by equal texts with one letter left out or masked; the checksum bit by bit, by a table made in SQL."""
    accents = "".join(chr(c) for c in range(0xC0, 0x100))
    bit = "(case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end)"
    return f"""
with recursive steps as (
  select i as byte, i::bigint as c, 0 as k from range(256) t(i)
  union all select byte, {bit}, k + 1 from steps where k < 8),
crc as (select list(c order by byte) as t from steps where k = 8),
runs as (
  select coalesce(cast(doc_id as varchar), '') as id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z{accents[0]}-{accents[-1]}]+')) as w
  from documents where text is not null),
per as (select id, w, count(*) as n from runs where length(w) >= {LENGTH} group by all),
hashed as (
  select w, n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, len(hex(id || ':' || w)) // 2),
      lambda i: ('0x' || substr(hex(id || ':' || w), 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1])), 4294967295) as h from per, crc),
words as (
  select case when h % {NOISE} = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from hashed),
v as (select word, cast(sum(n) as bigint) as n from words where length(word) >= {LENGTH} group by word having sum(n) >= {OCCURRENCES}),
cuts as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as b
  from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
pairs as (
  select x.word as a, y.word as b from cuts x join cuts y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select v.word, c.word from cuts c join v on v.word = c.a || c.b
  union select c.word, v.word from cuts c join v on v.word = c.a || c.b),
near as (
  select a as word, b, v.n as bn, count(*) over (partition by a) as n_near,
    row_number() over (partition by a order by v.n desc, b) as r from pairs join v on v.word = pairs.b),
forms as (
  select v.word, v.n, coalesce(n_near, 0) as n_near, case when bn >= {RATIO} * v.n then b end as form, case when bn >= {RATIO} * v.n then bn end as form_n
  from v left join near on near.word = v.word and r = 1),
walk as (
  select word, word as here from forms
  union all select walk.word, forms.form from walk join forms on forms.word = walk.here where forms.form is not null),
ends as (select walk.word, here as root from walk join forms on forms.word = here where form is null)
select word, form, root, n, n_near, form_n from forms join ends using (word)
"""
