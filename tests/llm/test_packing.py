import numpy as np
from granary.llm import packing as pk


def public_ids():
    """Ids by the tokenizers library, whose engine copes with long runs of white space."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.no_padding()
    library.no_truncation()
    library.encode_special_tokens = True
    return lambda text: library.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, awkward, empty):
    code = public_ids()
    rows = pk.pack(awkward, row=64, buffer_rows=8).collect()
    found = {}
    for r in rows:
        ids, pos = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == r.n_tokens <= 64 and list(r.cu_seqlens)[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for k, (doc, at) in enumerate(zip(r.doc_ids, r.piece_starts)):
            a, b = r.cu_seqlens[k], r.cu_seqlens[k + 1]
            assert list(pos[a:b]) == list(range(b - a))
            found.setdefault(doc, []).append((at, ids[a:b].tolist()))
    want = {}
    for r in awkward.collect():
        want.setdefault(r.doc_id, []).append(code(r.text or "") + [pk.SEPARATOR])
    for doc, texts in want.items():
        pieces = sorted(found[doc])
        assert sorted(x for _, p in pieces for x in p) == sorted(x for t in texts for x in t)
        if len(texts) == 1:
            assert [x for _, p in pieces for x in p] == texts[0] and [at for at, _ in pieces] == list(np.cumsum([0] + [len(p) for _, p in pieces])[:-1])
    assert pk.op2_packing(empty).count() == 0


def test_best_fit():
    rnd = np.random.default_rng(1)
    for _ in range(100):
        row = int(rnd.integers(1, 50))
        sizes = rnd.integers(1, row + 1, int(rnd.integers(0, 40)))
        free, n = [], 0
        for s in sorted(sizes.tolist(), reverse=True):
            fit = [f for f in free if f >= s]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - s)
            else:
                free.append(row - s)
                n += 1
        bins = pk.best_fit_decreasing(sizes, row)
        assert len(bins) == n and sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert sorted(row - sum(int(sizes[i]) for i in b) for b in bins) == sorted(free)


def test_long_runs_do_not_stop_the_encoder():
    """Runs of a million characters, alone and inside words; ids are those of the library where it copes."""
    code = pk.encoder(pk.default_ranks())
    n = 1_000_000
    for t in (" " * n, "\n" * n, "a" + " " * n + "b", "a" + "\n" * n, "x " * 1_000 + "\t" * n + "'ll " * 1_000, "z" * n, "7" * n, "-" * n):
        assert code.code.decode(code.encode(t)) == t
    for k in (255, 256, 257, 1_000):
        for t in (" " * k + "b", "a" + "\n" * k + "b", "a" + " " * k, "a \n" * k + " " * k + "12", "\r\n" * k + "..", " " * k + "<|endoftext|>"):
            assert code.encode(t).tolist() == code.code.encode_ordinary(t)


def test_written_matrix_comes_back(spark, awkward, tmp_path):
    packed = pk.pack(awkward, row=64, buffer_rows=8)
    path = f"file://{tmp_path}/matrix"
    pk.write_packed(packed, path, row=64)
    rows = sorted((bytes(r["ids"]), tuple(r.cu_seqlens)) for r in packed.collect())
    found = []
    for ids, limits, resets in pk.read_packed(path):
        assert ids.dtype == np.uint16 and ids.shape == (len(limits), 64)
        want = []
        for k, (line, cu) in enumerate(zip(ids, limits)):
            assert (line[cu[-1] :] == pk.SEPARATOR).all()
            found.append((line[: cu[-1]].tobytes(), tuple(cu.tolist())))
            want += [64 * k + int(c) for c in cu if c < 64]
        assert resets.tolist() == want
    assert sorted(found) == rows


def test_larger_vocabularies_get_wider_ids(spark, tmp_path):
    import base64

    ranks = tmp_path / "wide.tiktoken"
    tokens = [bytes([i]) for i in range(256)] + [f"{i:05d}".encode() for i in range(70_000 - 256)]
    ranks.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    row = pk.pack(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), ranks=str(ranks), row=8).first()
    assert np.frombuffer(row["ids"], "<u4").tolist() == [97, 98, 70_000]
