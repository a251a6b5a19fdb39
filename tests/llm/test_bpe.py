import hashlib
import random
import struct
import subprocess
import sys

import pytest
from granary.llm import bpe
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def both():
    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)

    def reference(text):
        ids = library.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)

    return bpe.codec(path), reference


def test_texts(both):
    codec, reference = both
    rnd = random.Random(1)
    parts = ["a", "b", "the", " ", "  ", "\n", "'ll", "'s", "é", "1", "22", "<|endoftext|>", "<|", "zzzz", "-----", "\t", "日本", "😀", " ", "____"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 50))) for _ in range(800)]
    texts += ["a" * 5_000, "ab" * 9_000, " " * 70_000 + "x", "=-" * 2_000, "x" * 65_535 + "'ll" + "y'l" + " z", ""]
    for t in texts:
        ids, text = reference(t)
        assert codec.encode(t) == ids
        assert codec.decode(ids) == text


def test_streaming_gives_stable_tokens_and_holds_little(both):
    codec, reference = both
    t = bpe.Transducer(codec.v)
    data = ("abcab" * 4_000).encode()
    out, most = [], 0
    for i in range(0, len(data), 700):
        out += t.feed(data[i : i + 700])
        most = max(most, len(t.text))
    out += t.finish()
    assert bpe._packed(out) == reference(data.decode())[0]
    assert most <= 16 * codec.v.lookahead
    pieces = ["one two", " three'", "ll fou", "r" * 70_000, "   ", "\n x"]
    assert b"".join(codec.encode_stream(pieces)) == codec.encode("".join(pieces))


def test_bad_bytes_decode_to_replacement(both):
    codec, _ = both
    bad = bpe._packed([codec.v.ids[b"\xc3"], codec.v.ids[b"a"]])
    assert codec.decode(bad) == "�a"


def test_query(both, awkward, empty):
    _, reference = both
    want = []
    for r in awkward.collect():
        ids, text = reference(r.text or "")
        want.append((r.doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.op4_bpe(awkward).collect()), key=str) == sorted(want, key=str)
    assert bpe.op4_bpe(empty).count() == 0


def test_classes_of_the_plain_pattern(both):
    codec, reference = both
    every = [chr(c) for c in range(0x2B0)]
    texts = ["".join(f"a{c}b 1{c}2 {c}{c} ." for c in every), " ".join(every), "".join(every)]
    for t in texts:
        assert bpe._PLAIN.findall(t) == codec.v.pattern.findall(t)
        assert codec.encode(t) == reference(t)[0]


def test_settled_on_demand_equals_settled_in_turn(both):
    codec, _ = both
    rnd, t = random.Random(2), bpe.Transducer(codec.v)
    for _ in range(3_000):
        data = "".join(rnd.choice("aeinrst ---==é") for _ in range(rnd.randint(1, 40))).encode()
        assert t.whole(data) == t.feed(data) + t.finish()


def test_pre_tokens_longer_than_chunks_are_fed_on(both, monkeypatch):
    """Runs of each class over many chunks, of every phase against the chunks' borders, and what is held meanwhile."""
    codec, reference = both
    monkeypatch.setattr(bpe, "CHUNK", 64)
    held = []
    feed = bpe.Transducer.feed
    monkeypatch.setattr(bpe.Transducer, "feed", lambda self, piece: held.append(len(piece)) or feed(self, piece))
    rnd = random.Random(5)
    for run in ("a", "é", "7", "-", " ", "\n", "日", "ab"):
        for n in (30, 63, 64, 65, 127, 128, 129, 130, 1_000):
            for before, after in (("", ""), ("x ", "y"), ("1 ", "'ll go"), (" ", " z"), ("..", "\n"), ("w", ".")):
                t = before + run * n + after
                for size in (64, rnd.randint(1, 50)):
                    pieces = [t[i : i + size] for i in range(0, len(t), size)]
                    assert b"".join(codec.encode_stream(pieces)) == reference(t)[0], (run, n, before, after, size)
    assert max(held) <= 2 * 64 * 4


def test_both_ways_agree_at_the_lookahead(both):
    codec, _ = both
    rnd, t, n = random.Random(3), bpe.Transducer(codec.v), codec.v.lookahead
    for size in range(n - 3, n + 4):
        for _ in range(20):
            data = "".join(rnd.choice("aeinrst-=") for _ in range(size)).encode()
            fed = t.feed(data) + t.finish()
            assert t.whole(data) == fed
            assert b"".join(codec.v.bytes_of[i] for i in fed) == data


TASK = r"""
import random, re
from granary.llm import bpe, common

def taken():
    return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

begun = taken()
codec = bpe.codec(bpe.default_vocabulary())
list(common.tidy(iter)([]))
loaded, rnd = taken(), random.Random(7)

def run(batches):
    for n in batches:
        codec.encode(" ".join("".join(rnd.choices("aeinrstlomkuéö-1", k=rnd.randint(5, 12))) for _ in range(n)))
        yield taken()
    codec.forget()

most = max(common.tidy(run)([500] * 700))
print(loaded - begun, most - loaded, taken() - loaded)
"""


def test_memory_of_a_worker_over_a_task_of_distinct_words():
    """Vocabulary, what is remembered of 350,000 words at most, and what stays after the task, in MB."""
    said = subprocess.run([sys.executable, "-c", TASK], check=True, capture_output=True, text=True).stdout
    vocabulary, remembered, left = map(float, said.split())
    assert vocabulary < 31 and remembered < 58 and left < 33, said
