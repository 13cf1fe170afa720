"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import inspect
import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from winnow.llm import common, digest, edits, forest, html_crf, langid, line_dedup, near_dedup, packing, pieces, sharding, simhash, vectors, warc

SF = "/root/testdata/sf0.001"


def read(name):
    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet' ORDER BY 1").fetchall()


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    r = random.Random(1)
    alphabet = ["ab c", "  \n\t", "日本 のx", "<0x0A>", "éß ", "🎉 a", "1234 .,;", "the and ", "aaaa", "      "]
    texts = [t[1] for t in read("documents")[:60]] + ["".join(r.choice(r.choice(alphabet)) for _ in range(r.randrange(1, 50))) for _ in range(300)] + [" " * i + "the" for i in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (1 << 28, 0):
        got = {x.doc_id: x for x in pieces.encode(frame, decoded=True, broadcast_bytes=limit, block_bytes=1 << 16).collect()}
        assert [got[i].ids for i in range(len(texts))] == [sp.encode(t) for t in texts]
        assert [got[i].decoded for i in range(len(texts))] == texts
    again = {x.doc_id: x.decoded for x in pieces.decode(pieces.encode(frame)).collect()}
    assert [again[i] for i in range(len(texts))] == texts


def test_groups_are_placed_as_by_the_rule():
    r = np.random.default_rng(2)
    for _ in range(20):
        sizes, n = r.integers(1, 100, (r.integers(1, 60), 3)).astype(float), int(r.integers(1, 6))
        share = sizes / sizes.sum(axis=0) * n
        room, want = [[1.02] * 3 for _ in range(n)], {}
        for k in sorted(range(len(sizes)), key=lambda k: -max(share[k])):
            fits = [b for b in range(n) if all(room[b][d] >= share[k][d] for d in range(3))]
            want[k] = max(fits or range(n), key=lambda b: (sum(room[b][d] * share[k][d] for d in range(3)), -b))
            room[want[k]] = [room[want[k]][d] - share[k][d] for d in range(3)]
        got = sharding.pack_groups(sizes, n)
        # Sums in another order may break a tie differently, so the loads are compared.
        loads = lambda where: sorted(round(sum(share[k][0] for k in range(len(sizes)) if where[k] == b), 6) for b in range(n))
        assert loads(got) == loads(want)


def test_shards_are_balanced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(docs, target_bytes=256 << 10).groupBy("shard").sum("bytes", "tokens").collect()
    assert len(got) > 8
    for k in (1, 2):
        load = [r[k] for r in got]
        assert max(load) <= 1.15 * sum(load) / len(load)


def test_shards_of_several_blocks_are_balanced(spark):
    r = random.Random(3)
    rows = [(k, " ".join("word" * r.randrange(1, 4) for _ in range(r.randrange(50, 400))), f"s{min(k % 37, 9)}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sharding.shard(docs, target_bytes=128 << 10, shards_per_block=8).groupBy("shard").agg({"bytes": "sum", "tokens": "sum", "doc_id": "count"}).collect()
    assert len({x.shard // 1_000_000 for x in got}) >= 3 and len(got) >= 24
    for column in ("sum(bytes)", "sum(tokens)", "count(doc_id)"):
        load = [x[column] for x in got]
        # Blocks get their groups by hash, so shards of different blocks differ more than those of one.
        assert max(load) <= 1.5 * sum(load) / len(load), column


def test_nnls_meets_the_optimality_conditions():
    r = np.random.default_rng(4)
    for _ in range(20):
        a, b = r.random((12, 30)), r.random(12) * 3
        x = packing.nnls(a, b)
        w = a.T @ (b - a @ x)
        assert (x >= 0).all() and (w <= 1e-6).all() and np.abs(w[x > 1e-9]).max(initial=0) < 1e-6


def test_plan_uses_every_piece_once_and_wastes_little():
    r = np.random.default_rng(5)
    for _ in range(10):
        hist = r.integers(0, 400, 32)
        plan = packing.plan_packs(hist)
        used = np.zeros(32, int)
        for times, combo in plan:
            assert sum(i * k for i, k in combo.items()) <= 32
            for i, k in combo.items():
                used[i - 1] += times * k
        assert (used == hist).all()
        packs, need = sum(t for t, _ in plan), (hist * np.arange(1, 33)).sum() / 32
        assert packs <= 1.1 * max(need, hist[16:].sum()) + 20


def test_every_shallow_combination_is_there():
    a = packing.shallow_combinations(9, 3)
    want = {c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(range(1, 10), n) if sum(c) == 9}
    got = {tuple(i + 1 for i in range(9) for _ in range(int(col[i]))) for col in a.T}
    assert got == want and a.shape[1] == len(want)


def test_packing_places_each_token_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, window=256, grid=8, rows_per_bucket=40).collect()
    want = {d[0]: len(d[1].split()) for d in read("documents")}
    have, spans = {}, {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
        if r.pack_id is not None:
            spans.setdefault(r.pack_id, []).append((r.pack_offset, r.n_tokens))
    assert have == want
    for s in spans.values():
        s.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(s, s[1:])) and s[-1][0] + s[-1][1] <= 256
    assert sum(want.values()) / (256 * len(spans)) > 0.9


def brute_groups(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("wide", [4, 512])
def test_buckets_against_brute_force(monkeypatch, wide):
    monkeypatch.setattr(forest, "WIDE", wide)
    r = np.random.default_rng(0)
    for k in range(40):
        n, limit = int(r.integers(2, 300)), 10
        key = r.integers(0, 15, n).astype(np.uint64)
        fp = r.integers(0, 2**63, (25, 2)).astype(np.uint64)[r.integers(0, 25, n)].copy()
        for _ in range(r.integers(0, 14)):
            fp[:, 0] ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
        size = r.integers(1, 40, n) if k % 2 else None
        near = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1) <= limit) & (key[:, None] == key[None])
        fits = np.minimum(size[:, None], size[None]) >= 0.8 * np.maximum(size[:, None], size[None]) - 1e-6 if k % 2 else np.ones((n, n), bool)
        i, j, label = forest.bucket_edges(key, fp, limit, size=size, ratio=0.8)
        assert near[i, j].all()
        # With sizes, neighbours are joined whatever their sizes; every pair that fits must be joined.
        groups = brute_groups(n, zip(i.tolist(), j.tolist()))
        assert all(groups[a] == groups[b] and label[a] == label[b] for a, b in np.argwhere(near & fits).tolist())
        assert len(set(groups)) == len(set(label.tolist())) >= len(set(brute_groups(n, np.argwhere(near).tolist())))
        again = forest.bucket_edges(key, fp, limit, label=label, size=size, ratio=0.8)
        assert not len(again[0]) and (again[2] == label).all()
        label = r.integers(0, 5, n)
        i, j = forest.cross_pairs(key, label, fp, limit, size, 0.8)
        want = {tuple(sorted(p)) for p in np.argwhere(near & fits & (label[:, None] != label[None])).tolist()}
        assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


@pytest.mark.parametrize("crowd", [3, 40, 10_000])
def test_rows_in_order_of_size_against_brute_force(crowd):
    r = np.random.default_rng(1)
    for _ in range(30):
        n, limit = int(r.integers(0, 300)), 10
        key = r.integers(0, 15, n).astype(np.uint64)
        fp = r.integers(0, 2**63, (25, 2)).astype(np.uint64)[r.integers(0, 25, n)].copy()
        for _ in range(r.integers(0, 14)):
            fp[:, 0] ^= np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)
        size = np.sort(r.integers(1, 40, n))
        near = (np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1) <= limit) & (key[:, None] == key[None])
        fits = near & (np.minimum(size[:, None], size[None]) >= 0.8 * np.maximum(size[:, None], size[None]) - 1e-6)
        i, j, label = forest.sized_edges(key, fp, size, limit, 0.8, np.arange(n), True, crowd)
        assert near[i, j].all() and len(i) < max(1, n)
        groups = brute_groups(n, zip(i.tolist(), j.tolist()))
        assert all(groups[a] == groups[b] and label[a] == label[b] for a, b in np.argwhere(fits).tolist())
        label = r.integers(0, 5, n)
        i, j, _ = forest.sized_edges(key, fp, size, limit, 0.8, label, False, crowd)
        want = {tuple(sorted(p)) for p in np.argwhere(fits & (label[:, None] != label[None])).tolist()}
        assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())} == want and len(i) == len(want)


def morse(n):
    """Two strings that a polynomial modulo 2^64 can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_thue_morse_strings_apart(spark):
    a, b = morse(2048)
    one, two = morse(512)
    data, offsets = simhash.buffers(pa.array([a, b, one, two, " ".join(a), " ".join(b)]))
    _, h, first = simhash.words(data, offsets)
    assert len(set(h[:4].tolist())) == 4 and len(set(simhash.sequence_hash(h, first).tolist())) == 6
    frame = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, one), (4, two)], "doc_id long, text string")
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(frame).collect() if r.doc_id > 2)
    assert {r.doc_id: r.decoded for r in pieces.encode(frame.where("doc_id > 2"), decoded=True).collect()} == {3: one, 4: two}


def test_contents_of_one_hash_stay_apart(spark):
    rows = spark.createDataFrame([(7, 1, 10), (7, 1, 10), (7, 2, 20), (8, 3, 30)], "node long, check long, f0 long")
    moved, nodes = common.nodes_of(rows, ["f0"])
    assert nodes.count() == 3 and moved.select("node", "check").distinct().count() == 3 and moved.count() == 4
    assert {r.f0 for r in nodes.collect()} == {10, 20, 30}


def test_fingerprints_do_not_depend_on_the_batch():
    texts = [d[1] for d in read("documents")]
    whole, _ = simhash.of_texts(pa.array(texts))
    for k in (0, 7, 55):
        assert (simhash.of_texts(pa.array(texts[k : k + 1]))[0][0] == whole[k]).all()
    assert (simhash.of_texts(pa.array(["The fox, the fox!"]))[0] == simhash.of_texts(pa.array(["fox THE"]))[0]).all()


def test_near_duplicates_reach_the_recall(spark):
    docs = read("documents")
    texts = [d[1] for d in docs]
    r = random.Random(3)
    for t in texts[:60]:
        w = t.split(" ")
        for _ in range(max(1, len(w) // 25)):
            w[r.randrange(len(w))] = r.choice(("zebra", "quartz", "vivid"))
        texts.append(" ".join(w))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.group_id for x in near_dedup.near_duplicates(frame).collect()}
    fp, _ = simhash.of_texts(pa.array(texts))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if int(np.bitwise_count(fp[a] ^ fp[b]).sum()) <= 24]
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.95 * len(pairs)
    want = brute_groups(len(texts), pairs)
    assert all(want[a] == want[b] for a in range(len(texts)) for b in range(a) if got[a] == got[b])


def within(a, b, most):
    """Whether the Levenshtein distance is at most most, by the table's band."""
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        lo, hi = max(1, i - most), min(len(b), i + most)
        new = [most + 1] * (len(b) + 1)
        new[0] = i
        for j in range(lo, hi + 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != b[j - 1]))
        row = new
        if min(row) > most:
            return False
    return row[-1] <= most


def test_line_dedup_against_brute_force(spark):
    texts = read("documents")
    r = random.Random(9)
    varied = []
    for d in texts[:40]:
        for line in d[1].split("\n")[:4]:
            w = line.split(" ")
            if len(w) > 12:
                w[r.randrange(len(w))] = r.choice(("zebra", "quartz", "vivid"))
                varied.append(" ".join(w))
    rows = [(d[0], d[1]) for d in texts] + [(10_000 + k, t) for k, t in enumerate(varied)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {x.doc_id: x.text.split("\n") for x in line_dedup.dedup_lines(docs).collect()}
    norm = lambda line: " ".join("".join(c if c.isalnum() else " " for c in line.lower()).split())
    first, exact = set(), 0
    for i, t in rows:
        lines = t.split("\n")
        assert all(x in lines for x in out[i] if x)
        for x in filter(None, map(norm, lines)):
            exact += x in first
            first.add(x)
    # A repeat of the same words never stays twice, however short.
    kept = [norm(x) for lines in out.values() for x in lines if norm(x)]
    assert len(kept) == len(set(kept)) and exact > 0

    lines = sorted(first, key=len)
    data, offsets = simhash.buffers(pa.array(lines))
    _, h, bound = simhash.words(data, offsets)
    node, fp = simhash.sequence_hash(h, bound).view(np.int64), simhash.fingerprints(h, bound)
    label = {x.node: x.label for x in line_dedup.line_groups(docs)[1].collect()}
    same = lambda a, b: label.get(int(node[a]), -1) == label.get(int(node[b]), -2)
    bag = np.zeros((len(lines), 400), np.int32)
    for k, x in enumerate(lines):
        np.add.at(bag[k], [ord(c) % 400 for c in x], 1)
    close = [[], []]
    for a in range(len(lines)):
        for b in range(a + 1, len(lines)):
            most = int(0.1 * len(lines[b]) + 1e-9)
            if len(lines[b]) - len(lines[a]) > most:
                break
            if np.abs(bag[a] - bag[b]).sum() <= 2 * most and within(lines[a], lines[b], most):
                close[int(np.bitwise_count(fp[a] ^ fp[b]).sum()) < 12].append((a, b))
    far, near = close
    # Twelve blocks can't all be hit by fewer than twelve bits; of all similar pairs, at any distance, nine tenths are found.
    assert len(near) > 40 and all(same(a, b) for a, b in near)
    assert sum(same(a, b) for a, b in near + far) >= 0.9 * len(near + far)
    # Nothing that isn't connected through similar pairs shares a group.
    want = brute_groups(len(lines), near + far)
    by_label = {}
    for k in range(len(lines)):
        if int(node[k]) in label:
            by_label.setdefault(label[int(node[k])], set()).add(want[k])
    assert by_label and all(len(v) == 1 for v in by_label.values())


def test_multi_sequence_order_is_that_of_all_cells():
    r = np.random.default_rng(6)
    x, books = r.random((40, 8)).astype(np.float32), (r.random((9, 4)).astype(np.float32), r.random((7, 4)).astype(np.float32))
    got = vectors.visited(x, books, 12)
    d = ((x[:, None, :4] - books[0]) ** 2).sum(-1)[:, :, None] + ((x[:, None, 4:] - books[1]) ** 2).sum(-1)[:, None, :]
    want = np.argsort(d.reshape(40, -1), axis=1, kind="stable")[:, :12]
    assert np.allclose(np.take_along_axis(d.reshape(40, -1), got, 1), np.take_along_axis(d.reshape(40, -1), want, 1), atol=1e-5)


@pytest.mark.parametrize("kind", ["lines", "texts"])
@pytest.mark.parametrize("rows_in_bucket", [1_000_000, 500])
def test_pairs_at_the_limit_are_found_as_often_as_promised(spark, monkeypatch, kind, rows_in_bucket):
    """Both levels, with keys as long as 20,000 nodes need and as 2,000 times as many would."""
    monkeypatch.setattr(forest, "ROWS_IN_BUCKET", rows_in_bucket)
    of = {"lines": line_dedup.line_groups, "texts": near_dedup.groups}[kind]
    given = {k: p.default for k, p in inspect.signature(of).parameters.items() if k != "docs"}
    r = np.random.default_rng(6)
    bits = r.integers(0, 2, (20_000, 128), dtype=np.uint8)
    near = bits[:300].copy()
    for row in near:
        row[r.permutation(128)[: given["limit"]]] ^= 1
    fp = np.packbits(np.concatenate((bits, near)), axis=1).view(np.int64)
    nodes = spark.createDataFrame([(k, int(a), int(b), 100) for k, (a, b) in enumerate(fp)], "node long, f0 long, f1 long, size long")
    more = {"least": 10, "occupancy": 4, "blocks": True, "ratio": 0.9} if kind == "lines" else {"least": 5, "occupancy": 64}
    found = {(e.a, e.b) for e in forest.Forest(nodes, given["limit"], given["target"], **more).edges().collect()}
    assert np.mean([(k, 20_000 + k) in found for k in range(300)]) >= given["target"] - 0.04
    assert all(int(np.bitwise_count(fp[a].view(np.uint64) ^ fp[b].view(np.uint64)).sum()) <= given["limit"] for a, b in found)


def test_the_number_of_shuffled_keys_grows_slowly():
    counts = [[simhash.tries(max(least, int(np.ceil(np.log2(n / forest.ROWS_IN_BUCKET)))), limit, target) for n in (10**4, 10**8, 10**11)] for least, limit, target in ((10, 19, 0.91), (5, 24, 0.955))]
    assert counts[0][0] == counts[0][1] <= 14 and counts[0][2] <= 50 and counts[1][0] <= 10 and counts[1][2] <= 150


def test_ranks_count_the_nearer_cells():
    r = np.random.default_rng(6)
    x = r.standard_normal((50, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = (r.random((9, 4)).astype(np.float32), r.random((7, 4)).astype(np.float32))
    got = vectors.ranks(x, books, 0.9)
    for k, order in enumerate(vectors.visited(x, books, 63)):
        d = ((x[k, :4] - books[0]) ** 2).sum(1)[:, None] + ((x[k, 4:] - books[1]) ** 2).sum(1)[None]
        assert np.isclose(d.reshape(-1)[order[got[k]]], np.sort(d.reshape(-1))[got[k]], atol=1e-5)


def test_vectors_reach_the_recall(spark):
    r = np.random.default_rng(7)
    base = np.array([v[1] for v in read("embeddings")], np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = r.standard_normal(base[:200].shape)
    noise -= (noise * base[:200]).sum(1, keepdims=True) * base[:200]
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.concatenate([base] + [c * base[:200] + np.sqrt(1 - c * c) * noise for c in (0.97, 0.91)]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {v.vec_id: v.group_id for v in vectors.near_duplicates(frame, occupancy=8).collect()}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    pairs = np.argwhere(np.triu(n @ n.T >= 0.9, 1))
    assert sum(got[a] == got[b] for a, b in pairs.tolist()) >= 0.9 * len(pairs)


def test_messages_give_the_marginals_of_enumeration():
    r = np.random.default_rng(8)
    page = "<body><nav><a href=x>one</a></nav><div class=c><p>two, three.</p>four</div></body>"
    f = html_crf.Forest.of([page])
    w, pair = r.standard_normal(html_crf.N_FEATURES), r.standard_normal((2, 2, 2))
    n = len(f.parent)
    score = {}
    for y in itertools.product((0, 1), repeat=n):
        s = sum(float(f.x[i] @ w) for i in range(n) if y[i])
        s += sum(pair[f.edge[i], y[f.parent[i]], y[i]] for i in range(n) if f.parent[i] >= 0)
        score[y] = np.exp(s)
    z = sum(score.values())
    p, joint, log_z = f.marginals(w, pair)
    assert np.allclose(p, [sum(v for y, v in score.items() if y[i]) / z for i in range(n)])
    assert np.isclose(log_z[0], np.log(z))
    i = n - 1
    assert np.allclose(joint[i], [[sum(v for y, v in score.items() if y[f.parent[i]] == a and y[i] == b) / z for b in (0, 1)] for a in (0, 1)])


def test_content_of_held_out_pages():
    pages = [p[2] for p in duckdb.sql("SELECT * FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY 1").fetchall()]
    model = html_crf.fit(pages[:100])
    f = html_crf.Forest.of(pages[100:])
    p, _, _ = f.marginals(model.w, model.pair)
    text = np.array([t is not None for t in f.text])
    assert ((p >= 0.5) == f.under)[text].mean() > 0.97


def test_languages_of_held_out_documents():
    docs = [d for d in duckdb.sql("SELECT doc_id, text, lang FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY 1").fetchall()]
    model = langid.fit([d[1] for d in docs[:400]], [d[2] for d in docs[:400]])
    assert model.families == ["germanic", "romance"] and [p[0] for p in model.pairs] == [0, 1]
    got = model.predict(pa.array([d[1] for d in docs[400:]]), 0.5)
    assert np.mean([a == d[2] for a, d in zip(got["lang_id"], docs[400:])]) > 0.98 and np.mean(got["accepted"]) > 0.99
    assert model.predict(pa.array(["Это русский текст о лесе", "これは日本語です", "zq xj qz kx"]), 0.5)["accepted"][:2] == [False, False]


def test_entropy_and_features_against_the_definition():
    text = read("documents")[3][1].encode()[:1500]
    data = np.frombuffer(text, np.uint8)
    level = digest.entropies(data)
    for i in (0, 1, 63, 64, 500, len(text) - 64):
        c = np.bincount(data[i : i + 64])
        c = c[c > 0] / 64
        assert abs(level[i] - 1000 * -(c * np.log2(c)).sum() / 6) <= 1
    rank = np.random.default_rng(1).permutation(1001)
    got = digest.features(data, np.array([0, len(data)]), rank)[1]
    r = rank[level]
    count = np.zeros(len(r), int)
    for i in range(len(r) - 63):
        count[i + int(np.argmin(r[i : i + 64]))] += 1
    assert len(got) == len([i for i in np.flatnonzero(count >= digest.POPULAR) if level[i] >= digest.LEAST_ENTROPY])
    both = np.concatenate((data, data))
    twice = digest.features(both, np.array([0, len(data), len(both)]), rank)
    assert (twice[1][: len(got)] == got).all() and (twice[1][len(got) :] == got).all()


def test_filters_hold_what_was_put_in_and_overlap_is_normalised():
    h = np.random.default_rng(2).integers(0, 2**63, 400).astype(np.uint64)
    chain, bits = digest.filters(np.zeros(400, np.int64), h, 1)
    assert chain.tolist() == [3]
    flags = np.unpackbits(bits, axis=1)
    for k, x in enumerate(h.tolist()):
        assert all(flags[k // digest.PER_FILTER, (x >> (11 * s)) & 2047] for s in range(5))
    other = digest.filters(np.zeros(400, np.int64), np.random.default_rng(3).integers(0, 2**63, 400).astype(np.uint64), 1)[1]
    assert digest.overlap(bits.tobytes(), bits.tobytes()) == pytest.approx(100) and digest.overlap(bits.tobytes(), other.tobytes()) < 5


@pytest.mark.parametrize("block", [1, 7, 1 << 15])
def test_overlaps_of_many_pairs_against_the_definition(block):
    r = np.random.default_rng(3)

    def one(a, b):
        x, y = sorted((np.unpackbits(np.frombuffer(v, np.uint8)).reshape(-1, digest.BITS).astype(int) for v in (a, b)), key=len)
        best = []
        for f in x:
            scores = [0.0]
            for g in y:
                chance, most = f.sum() * g.sum() / digest.BITS, min(f.sum(), g.sum())
                floor = chance + 0.3 * (most - chance)
                scores.append(100 * ((f & g).sum() - floor) / (most - floor) if (f & g).sum() > floor and most > floor else 0.0)
            best.append(max(scores))
        return np.mean(best) if best else 0.0

    pool = r.random((4, digest.BITS)) < r.random((4, 1)) / 2
    made = [np.packbits(pool[r.integers(0, 4, k % 5)] & (r.random(digest.BITS) < 0.9), axis=1).tobytes() for k in range(60)]
    a, b = made[:30], made[29:0:-1] + made[:1]
    got = digest.overlaps(pa.array([b"", *a], pa.binary()).slice(1), pa.array(b, pa.binary()), block)
    assert np.allclose(got, [one(x, y) for x, y in zip(a, b)]) and (got > 20).sum() > 5


def test_digests_find_versions(spark):
    texts = [d[1] for d in read("documents") if len(d[1]) > 600][:60]
    versions = [t[:200] + " inserted words here " + t[220:] for t in texts]
    frame = spark.createDataFrame(list(enumerate(texts + versions)), "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in digest.fingerprints(frame).collect()}
    assert np.mean([got[k] == got[k + len(texts)] for k in range(len(texts))]) >= 0.95


def test_digests_join_a_crowd_of_near_copies(spark):
    r = random.Random(4)
    known = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(5000)]
    text = [r.choice(known) for _ in range(870)]
    crowd = [" ".join(r.choice(known) if r.random() < 0.02 else w for w in text) for _ in range(40)]
    others = [" ".join(r.choice(known) for _ in range(870)) for _ in range(20)]
    got = {x.doc_id: x for x in digest.fingerprints(spark.createDataFrame(list(enumerate(crowd + others)), "doc_id long, text string")).collect()}
    assert [got[k].group_id for k in range(40)] == [0] * 40 and all(got[k].score >= 20 for k in range(40))
    assert [got[k].group_id for k in range(40, 60)] == list(range(40, 60))


def test_digests_find_excerpts_of_under_half_the_length(spark):
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(1500)) for _ in range(20)]
    excerpts = [t[k * 200 : k * 200 + len(t) // 4] for k, t in enumerate(texts)]
    got = {x.doc_id: x for x in digest.fingerprints(spark.createDataFrame(list(enumerate(texts + excerpts)), "doc_id long, text string")).collect()}
    assert all(2 * got[k + 20].n_features < got[k].n_features for k in range(20))
    assert [got[k + 20].group_id for k in range(20)] == list(range(20)) and all(got[k + 20].score >= 20 for k in range(20))


def test_warc_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    rel = con.sql(warc.ORACLE_SQL)
    got = warc.derive(warc.responses(spark.read.parquet(f"{SF}/pages.parquet")))
    assert sorted(map(repr, (tuple(r[c] for c in rel.columns) for r in got.collect()))) == sorted(map(repr, rel.fetchall()))
    assert warc.serialized(got).where("substring(record, 1, 8) = cast('WARC/1.1' as binary)").count() == 100


def told(model, text, min_known):
    """Language identification by its definition, one trigram after the other."""
    data = (text or "").lower().encode()
    letter = [97 <= b <= 122 or b >= 128 for b in data]
    folded = [b if ok else 32 for b, ok in zip(data, letter)]
    total = known = 0
    score = [0.0] * len(model.weights)
    for i in range(len(data) - 2):
        if letter[i + 1]:
            h = int(langid._T[0][folded[i]] ^ langid._T[1][folded[i + 1]] ^ langid._T[2][folded[i + 2]])
            total += 1
            known += bool(model.known[h])
            for k, w in enumerate(model.weights):
                score[k] += float(w[h % langid.SPACE])
    if not total or known / total < min_known:
        return None, None
    score = [s / total for s in score]
    f = max(range(len(model.families)), key=lambda k: (score[k], -k))
    names = model.members[f]
    votes, margin = [0] * len(names), [0.0] * len(names)
    for (a, i, j), s in zip(model.pairs, score[len(model.families) :]):
        if a == f:
            votes[i if s >= 0 else j] += 1
            margin[i] += s
            margin[j] -= s
    return names[max(range(len(names)), key=lambda k: (votes[k], margin[k], -k))], model.families[f]


def test_languages_against_the_definition(spark):
    docs = read("documents")
    # A third language in one family, so that votes are counted among three machines.
    pt = ["o menino não viu a água do mar e voltou para casa com o irmão", "os livros que ela lê são muito bons e não custam nada", "amanhã vamos à praia se não chover de manhã"] * 4
    model = langid.fit([d[1] for d in docs[:80]] + pt, [d[2] for d in docs[:80]] + ["pt"] * len(pt))
    assert model.members[model.families.index("romance")] == ["es", "fr", "pt"]
    rows = [(d[0], d[1]) for d in docs] + [(1000 + k, t) for k, t in enumerate(pt[:3] + ["", "  ", "%%%", "ça va", "日本語", "the die la", None])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    seen = set()
    for i, t in rows:
        lang, family = told(model, t, 0.5)
        seen.add(lang)
        assert (got[i].lang_id, got[i].family, got[i].accepted) == (lang, family, lang is not None)
    assert seen >= {"es", "pt", "fr", "de", "en", None}


def test_ties_of_languages_go_to_the_first_name():
    n = langid.SPACE
    model = langid.Model(["f", "g"], [["a", "b", "c"], ["x"]], [(0, 0, 1), (0, 0, 2), (0, 1, 2)], np.zeros((5, n), np.float32), np.ones(langid.KNOWN, bool))
    assert model.predict(pa.array(["any text"]), 0.5)["lang_id"] == ["a"]
    # A circle of votes with equal margins: everyone beats one other.
    model.weights[2:] = np.array([1, -1, 1], np.float32)[:, None]
    assert model.predict(pa.array(["any text"]), 0.5)["lang_id"] == ["a"]


def test_digests_against_brute_force(spark):
    texts = [d[1] for d in read("documents")][:90]
    r = random.Random(8)
    for t in texts[:30]:
        w = t.split(" ")
        for _ in range(1 + len(w) // 40):
            w[r.randrange(len(w))] = r.choice(("zebra", "quartz", "vivid"))
        texts.append(" ".join(w))
    texts += [t[len(t) // 3 : len(t) // 3 + len(t) // 2] for t in texts[:20]] + ["short", "short", ""]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {x.doc_id: x for x in digest.fingerprints(frame).collect()}
    like = {(a, b): digest.overlap(rows[a].digest, rows[b].digest) for a in rows for b in rows if a < b and rows[a].digest and rows[b].digest}
    pairs = [p for p, s in like.items() if round(s, 4) >= 20.0]
    same = {}
    for k, t in enumerate(texts):
        same.setdefault(t, k)
    copies = [(same[t], k) for k, t in enumerate(texts) if same[t] != k]
    assert len(pairs) >= 40
    # Of the pairs whose digests are that alike, nine tenths share a group; and nothing else joins texts.
    assert sum(rows[a].group_id == rows[b].group_id for a, b in pairs) >= 0.9 * len(pairs)
    want = brute_groups(len(texts), pairs + copies)
    assert all(want[a] == want[b] for a in rows for b in rows if rows[a].group_id == rows[b].group_id)
    assert all(rows[a].group_id == rows[b].group_id for a, b in copies)


def test_distances_against_the_table():
    r = random.Random(1)
    for wide in (False, True):
        x, y, most = [], [], []
        for _ in range(1500):
            letters = r.choice(["ab", "abcé", "日本語x"] + ["🎉ab"] * wide)
            a = [r.choice(letters) for _ in range(r.randrange(20))]
            b = list(a)
            for _ in range(r.randrange(8)):
                k = r.randrange(len(b) + 1)
                b[k : k + r.randrange(2)] = r.choice([[], [r.choice(letters)]])
            x.append("".join(a))
            y.append("".join(b))
            most.append(r.randrange(7))
        got = edits.within(pa.array(x), pa.array(y), np.array(most))
        assert got.tolist() == [within(a, b, m) for a, b, m in zip(x, y, most)] and 200 < got.sum() < 1400
    assert edits.within(pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0)).tolist() == []


@pytest.mark.parametrize("band, few", [(0, 0), (1, 0), (3, 0), (3, 600)])
def test_bands_of_bits_against_the_table(monkeypatch, band, few):
    monkeypatch.setattr(edits, "BAND", band)
    monkeypatch.setattr(edits, "FEW", few)
    monkeypatch.setattr(edits, "NEAR", 3)
    r = random.Random(2)
    rows = []
    for k in range(240):
        alphabet = r.choice(["ab", "abcdefgh ", "aé日🎉b"])
        x = [r.choice(alphabet) for _ in range(r.choice([3, 40, 130, 260]))]
        y = list(x)
        for _ in range(r.randrange(0, 1 + len(x) // 3)):
            at = r.randrange(len(y) + 1)
            y[at : at + r.randrange(2)] = r.choice(alphabet) * r.randrange(2)
        far = by_the_table("".join(x), "".join(y))
        rows += [("".join(x), "".join(y), max(0, far + d), d >= 0) for d in (-9, -1, 0, 1, 50) if far + d >= 0]
    x, y, most, want = zip(*rows)
    assert edits.within(pa.array(x), pa.array(y), np.array(most)).tolist() == list(want)


def by_the_table(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row = row, [i]
        for j, d in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return row[-1]


def test_the_pipeline_as_a_whole(spark, tmp_path):
    import shutil

    import corpus_pipeline

    shutil.copytree(SF, tmp_path / "sf", ignore=lambda d, names: [n for n in names if n != "documents.parquet"])
    docs = spark.read.parquet(str(tmp_path / "sf" / "documents.parquet"))
    packed = corpus_pipeline.run(spark, str(tmp_path / "sf")).collect()
    accepted = {r.doc_id for r in langid.identify(docs).where("accepted").collect()}
    cleaned = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs.where(docs.doc_id.isin(list(accepted)))).collect()}
    alive = {i: t for i, t in cleaned.items() if (t or "").strip()}
    placed = {}
    for r in packed:
        placed[r.doc_id] = placed.get(r.doc_id, 0) + r.n_tokens
    assert set(placed) <= set(alive) and all(n == len(alive[i].split()) for i, n in placed.items())
    # Whatever went at the third stage has a near duplicate with a smaller id that stayed or went for another; what stayed has none within 12 bits.
    ids = sorted(alive)
    fp, _ = simhash.of_texts(pa.array([alive[i] for i in ids]))
    far = np.bitwise_count(fp[:, None] ^ fp[None]).sum(-1)
    for k, i in enumerate(ids):
        nearest = far[k, :k].min(initial=999)
        assert (nearest > 12) if i in placed else (nearest <= 24 or far[k, k + 1 :].min(initial=999) <= 24), i
    assert len(placed) < len(ids) or (far + 999 * np.eye(len(ids), dtype=int) > 24).all()
