"""Byte-level BPE as a streaming transducer, and decoding as a byte-to-text state machine.

A token sequence is what the merge list makes of its text exactly if each pair of
neighbours is what the merge list makes of that pair.  So every prefix of a text has one last
token, found from the tokens that end there and the last tokens of shorter prefixes, and
encoding goes from left to right, a byte at a time: a state, the longest begin of a token that the text ends with, and
a byte give the next state and the tokens that end there, of which the longest that fits its neighbour is taken.  How far it must look ahead follows from the merge list:
a later byte can only refer back to prefixes that are shorter by the longest token at most,
so a token is stable, and leaves the transducer, once all those prefixes lead back to it.
What is held is bounded by that lookahead, not by the text.

Before that, texts are cut into pre-tokens by the vocabulary's pattern, chunk by chunk; a
pre-token is stable if it ends two characters before the end of what was read.  A pre-token
that goes on over chunks is fed to the transducer as it comes, by the class of characters that carries it on, so
neither a text nor a pre-token is held whole.  Pre-tokens of ordinary length are remembered with
their ids in a table of bounded size; all go through the same transducer.
"""

from __future__ import annotations

import codecs
import json
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, tidy

#: Pre-tokens longer than this stream through the transducer and are not remembered.
REMEMBERED = 64
#: Entries of one of two generations of remembered pre-tokens, some 130 bytes each.  Bounds a worker's memory, not results.
GENERATION = 75_000
#: Neighbours of which it is remembered whether they fit.
KNOWN_FITS = 1 << 18
#: Transitions that are remembered.
KNOWN_STEPS = 1 << 17
_BYTES = [bytes([b]) for b in range(256)]
CHUNK = 1 << 16
_FAR = 1 << 62
#: Characters of the first blocks of Unicode by class.  A text of these alone is cut by the standard
#: library's engine, which knows no such classes but takes half the time.
_LETTERS, _DIGITS, _SPACES = "A-Za-zªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
_BEYOND = re.compile("[^\x00-ʯ]")
_PLAIN = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pair_key(left: int, right: int) -> int:
    return left << 32 | right


class Vocabulary:
    """Tokens, merge tree and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        alphabet = str.maketrans({c: chr(b) for c, b in byte_alphabet().items()})
        spell = lambda t: t.translate(alphabet).encode("latin-1")
        self.ids = {spell(t): i for t, i in said["model"]["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in said["added_tokens"]}
        n_ids = 1 + max([*self.ids.values(), *self.added.values()])
        self.bytes_of: list[bytes | None] = [None] * n_ids
        for t, i in [*self.ids.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.bytes_of[i] = t
        #: Rank of each merge by its pair (``pair_key``); birth (-1: none) and halves of each token by its first merge.
        self.rank: dict[int, int] = {}
        self.born, self.left, self.right = (array("i", [-1]) * n_ids for _ in range(3))
        for rank, pair in enumerate(said["model"]["merges"]):
            left, right = (self.ids[spell(t)] for t in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.ids[self.bytes_of[left] + self.bytes_of[right]]
            self.rank[pair_key(left, right)] = rank
            if self.born[made] < 0:
                self.born[made], self.left[made], self.right[made] = rank, left, right
        #: Every prefix of a token that isn't one itself.
        self.begins = {b for t in self.ids for n in range(1, len(t)) if (b := t[:n]) not in self.ids}
        #: The lookahead that is sufficient for this merge list, in bytes.
        self.lookahead = max(len(t) for t in self.ids)
        self.pattern = regex.compile(
            r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        )
        #: What carries on a pre-token that began with a character of the class; white space leaves its last character.
        self.classes = [(regex.compile(first), regex.compile(on)) for first, on in ((r" ?\p{L}", r"\p{L}+"), (r" ?\p{N}", r"\p{N}+"), (r" ?[^\s\p{L}\p{N}]", r"[^\s\p{L}\p{N}]+"), (r"\s", r"\s+"))]
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.known_fits: dict[int, bool] = {}
        #: Transitions that were met: state and byte to the next state and the tokens that end there, long ones first.
        self.steps: dict[bytes, tuple[bytes, tuple[tuple[int, int], ...]]] = {}
        #: The states that these lead to, each once, and the tokens that end there with their lengths.
        self.states: dict[bytes, tuple[bytes, tuple[tuple[int, int], ...]]] = {}
        self.ends: dict[int, tuple[int, int]] = {}

    def step(self, read: bytes) -> tuple[bytes, tuple[tuple[int, int], ...]]:
        """The transition of a state and a byte, given as one."""
        state = next(t for k in range(len(read) + 1) if not (t := read[k:]) or t in self.ids or t in self.begins)
        if len(self.steps) >= KNOWN_STEPS:
            self.forget_steps()
        if (got := self.states.get(state)) is None:
            tokens = ((self.ids.get(state[k:]), len(state) - k) for k in range(len(state)))
            self.states[state] = got = state, tuple(self.ends.setdefault(t[0], t) for t in tokens if t[0] is not None)
        self.steps[read] = got
        return got

    def forget_steps(self) -> None:
        self.steps.clear()
        self.states.clear()
        self.ends.clear()

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return (self.pattern if _BEYOND.search(text) else _PLAIN).findall(text)

    def fits(self, a: int, b: int) -> bool:
        """Whether the merge list leaves the neighbours a, b as they are.

        Goes back in time, undoing the later birth of the two that touch; a merge of them that
        comes before either is merged away from the border would have been taken.
        """
        rank, born, left, right = self.rank, self.born, self.left, self.right
        x, y, x_until, y_until = a, b, _FAR, _FAR
        while True:
            r = rank.get(pair_key(x, y))
            if r is not None and r < x_until and r <= y_until:
                ok = False
                break
            x_born, y_born = born[x], born[y]
            if x_born < 0 and y_born < 0:
                ok = True
                break
            if y_born >= x_born:
                y, y_until = left[y], y_born
            else:
                x, x_until = right[x], x_born
        if len(self.known_fits) >= KNOWN_FITS:
            self.known_fits.clear()
        self.known_fits[pair_key(a, b)] = ok
        return ok


class Transducer:
    """Ids of one pre-token, fed in pieces of bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.reset()

    def reset(self) -> None:
        self.text = b""
        self.last: list[int] = []  # last token of each prefix of ``text``
        self.size: list[int] = []  # its length
        self.state = b""  # the longest begin of a token that ``text`` ends with
        self.before = -1  # token that was emitted before ``text``

    def feed(self, piece: bytes) -> list[int]:
        """Take bytes; give the ids that became stable."""
        out: list[int] = []
        step = 4 * self.v.lookahead
        for i in range(0, len(piece), step):
            self._extend(piece[i : i + step])
            if len(self.text) > 2 * step:
                out += self._stable()
        return out

    def finish(self) -> list[int]:
        out = self._chain(len(self.text))
        self.reset()
        return out

    def whole(self, data: bytes) -> list[int]:
        """Ids of a pre-token that is there whole."""
        return self.feed(data) + self.finish()

    def _extend(self, piece: bytes) -> None:
        """Settle the prefixes that end in ``piece``, each by the longest token that ends there and fits the one before it."""
        v, last, size, state, end = self.v, self.last, self.size, self.state, len(self.last)
        steps, known, fits, step = v.steps, v.known_fits, v.fits, v.step
        self.text += piece
        for b in piece:
            read = state + _BYTES[b]
            state, tokens = steps.get(read) or step(read)
            end += 1
            for token, n in tokens:
                before = last[end - n - 1] if n < end else self.before
                if before >= 0:
                    ok = known.get(before << 32 | token)
                    if not (fits(before, token) if ok is None else ok):
                        continue
                last.append(token)
                size.append(n)
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        self.state = state

    def _chain(self, end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(self.last[end - 1])
            end -= self.size[end - 1]
        return out[::-1]

    def _stable(self) -> list[int]:
        """Emit what every prefix that later bytes can refer to has in common."""
        n = len(self.text)
        tips = set(range(n - self.v.lookahead, n + 1))
        while len(tips) > 1:
            top = max(tips)
            tips.remove(top)
            tips.add(top - self.size[top - 1] if top > 0 else 0)
        at = tips.pop()
        if at <= 0:
            return []
        out = self._chain(at)
        self.before = out[-1]
        self.text, self.last, self.size = self.text[at:], self.last[at:], self.size[at:]
        return out


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Remembered(dict):
    """Pre-token to its ids as bytes; the older of two generations goes when the newer is full."""

    def __init__(self, v: Vocabulary):
        super().__init__()
        self.transducer, self.old = Transducer(v), {}

    def __missing__(self, word: str) -> bytes:
        if (got := self.old.get(word)) is None:
            got = _packed(self.transducer.whole(word.encode()))
            if len(word) > REMEMBERED:
                return got
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got


class Codec:
    """Text to ids and back, for one vocabulary file."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.memory = _Remembered(self.v)
        self.added = {t: _packed([i]) for t, i in self.v.added.items()}

    def forget(self) -> None:
        """Give back what was remembered of texts."""
        self.memory.clear()
        self.memory.old = {}
        self.v.known_fits.clear()
        self.v.forget_steps()

    def encode_stream(self, chunks: Iterable[str]) -> Iterator[bytes]:
        """Ids (unsigned 32 bits, little-endian) of a text without added tokens that comes in chunks."""
        held, going = "", None  # the class of a pre-token of which a part was fed
        transducer = Transducer(self.v)
        for chunk in chunks:
            held += chunk
            if going is not None:
                ids, held, going = self._carry_on(transducer, held, going, False)
                yield _packed(ids)
            if len(held) < CHUNK or going is not None:
                continue
            words = self.v.cut(held)
            end, n = len(held), len(words)
            while n and end > len(held) - 2:
                n -= 1
                end -= len(words[n])
            yield b"".join(map(self.memory.__getitem__, words[:n]))
            held = held[end:]
            if len(held) >= CHUNK // 2:
                going = next(on for first, on in self.v.classes if first.match(held))
                lead = 1 if held[0] == " " and not going.match(held) else 0  # a space before the class's characters
                ids = transducer.feed(held[:lead].encode())
                more, held, going = self._carry_on(transducer, held[lead:], going, False)
                yield _packed(ids + more)
        if going is not None:
            ids, held, _ = self._carry_on(transducer, held, going, True)
            yield _packed(ids)
        yield b"".join(map(self.memory.__getitem__, self.v.cut(held)))

    def _carry_on(self, transducer: Transducer, held: str, going: regex.Pattern, last: bool) -> tuple[list[int], str, regex.Pattern | None]:
        """Feed what of ``held`` belongs to the pre-token that is going on: (ids, what is left, the class if it still goes on)."""
        end = m.end() if (m := going.match(held)) else 0
        space = going is self.v.classes[-1][1]
        if end == len(held) and not last:
            keep = max(0, end - 1) if space else end
            return transducer.feed(held[:keep].encode()), held[keep:], going
        if space and end < len(held):
            end = max(0, end - 1)
        return transducer.feed(held[:end].encode()) + transducer.finish(), held[end:], None

    def encode(self, text: str) -> bytes:
        out = []
        for piece in self.v.split.split(text) if self.added else [text]:
            if piece in self.added:
                out.append(self.added[piece])
            elif len(piece) < CHUNK:
                out.append(b"".join(map(self.memory.__getitem__, self.v.cut(piece))))
            else:
                out.extend(self.encode_stream(piece[i : i + CHUNK] for i in range(0, len(piece), CHUNK)))
        return b"".join(out)

    def decode_stream(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """Text of ids that come in pieces of whole ids; bytes that aren't UTF-8 become U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in pieces:
            yield state.decode(b"".join(map(self.v.bytes_of.__getitem__, memoryview(ids).cast("I"))))
        yield state.decode(b"", final=True)

    def decode(self, ids: bytes) -> str:
        return "".join(self.decode_stream(ids[i : i + 4 * CHUNK] for i in range(0, len(ids), 4 * CHUNK)))


@cache
def codec(path: str) -> Codec:
    """One for each vocabulary and worker process."""
    return Codec(path)


def encode_decode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Token ids of every text, and the text that they decode to.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  ``vocabulary``: a
    byte-level BPE file that every executor can read.  One row per input row: ``doc_id``,
    ``ids`` (unsigned 32-bit little-endian) and ``decoded``.  Null counts as empty; an empty text
    has no ids; a null id stays null, rows that repeat give rows that repeat, and an empty table gives none.  Strings of added tokens in a text become those tokens.
    """
    bound_batches(docs.sparkSession)
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        try:
            yield from encoded(c, batches)
        finally:  # the worker lives on for other stages
            c.forget()

    def encoded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_column, texts = batch.column("doc_id"), batch.column("text")
            i = 0
            while i < len(texts):  # a megabyte or two at a time, whatever the batch
                ids, decoded, n, begin = [], [], 0, i
                while i < len(texts) and n < 1 << 20:
                    ids.append(c.encode(texts[i].as_py() or ""))
                    decoded.append(c.decode(ids[-1]))
                    n += len(ids[-1]) + len(decoded[-1])
                    i += 1
                columns = [ids_column.slice(begin, i - begin), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, ids binary, decoded string")


def op4_bpe(docs: DataFrame) -> DataFrame:
    return encode_decode(docs).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
