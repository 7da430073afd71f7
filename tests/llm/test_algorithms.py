import random

import numpy as np
import pytest

pytest.importorskip("tarnfold.llm")

from tarnfold.llm import bilstm, encoding, graph, languages, neighbours, packing, similar, transducer, vocabulary  # noqa: E402

TOKENIZERS = pytest.importorskip("os").path.isdir(vocabulary.FOLDER)
needs_files = pytest.mark.skipif(not TOKENIZERS, reason="no tokenizer files")


# Problem 1


def _brute(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    return {ids[i]: [ids[j] for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def test_graph_recall():
    r = np.random.RandomState(1)
    x = (r.randn(40, 32)[r.randint(0, 40, 3000)] + 0.7 * r.randn(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = x @ x.T
    edges, entries, _ = graph.build(x)
    ids, sims, compared = graph.beam_search(edges, x, x, graph.starts(x, x, entries))
    assert compared < 3000 * 600 and np.mean(sims[:, 0] > 0.9999) > 0.95
    np.fill_diagonal(table, -9)
    truth = np.argsort(-table, 1)[:, :10]
    got = [[j for j in row if j != i][:10] for i, row in enumerate(ids)]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth, got)]) > 0.9
    assert graph.build(x[:1])[0].shape == (1, graph.DEGREE)


def test_nearest(spark):
    r = np.random.RandomState(2)
    x = r.randn(300, 8).astype(np.float32)
    ids = np.arange(300) * 3
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)]
    bad = [(1000, None), (1001, [0.0] * 8), (1002, [1.0] * 7), (1003, [float("nan")] + [1.0] * 7), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + rows[:5] + bad, "id long, v array<float>")
    got = {r.id: list(r.near) for r in neighbours.nearest(df, "id", "v", 10, 8).collect()}
    truth = _brute(ids, x, 10)
    assert set(got) == set(truth)
    assert np.mean([len(set(got[i]) & set(truth[i])) / 10 for i in truth]) > 0.95
    assert neighbours.nearest(df.limit(0), "id", "v", 10, 8).collect() == []
    pairs = neighbours.pairs(neighbours.nearest(df, "id", "v", 1, 8), "id").collect()
    assert all(p.id_a < p.id_b for p in pairs)


def test_routing_costs_the_same_at_every_size():
    z = neighbours.Sizes()
    for count in (1, 200_000, 3_000_000, 9_000_000, 60_000_000, 10**9, 10**11):
        levels = neighbours.plan(count)
        assert all(n <= z.width for n in levels) and len(levels) <= (1 if count <= z.width * z.shard else 2 if count <= 10**9 else 3)
        shards = int(np.prod(levels, dtype=np.int64))
        # a shard, and so a graph, has no more vectors at any size, and a vector meets as many shards as there are levels, twice, at most
        assert count / shards <= z.limit < z.graph
        assert count < 10**6 or count / shards > z.shard / 3
        assert sum(levels) <= z.width * len(levels)


def test_nearest_over_several_levels(spark):
    r = np.random.RandomState(4)
    x = (3 * r.randn(12, 16)[r.randint(0, 12, 6000)] + r.randn(6000, 16)).astype(np.float16).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<float>")
    got = {row.id: list(row.near) for row in neighbours.nearest(df, "id", "v", 10, 16, neighbours.Sizes(4, 400, 900, 1200)).collect()}
    truth = _brute(np.arange(6000), x, 10)
    assert set(got) == set(truth)
    assert np.mean([len(set(got[i]) & set(truth[i])) / 10 for i in truth]) > 0.9


@pytest.mark.parametrize("copies", [5, 1000])
def test_many_identical_vectors(spark, monkeypatch, copies):
    monkeypatch.setattr(neighbours, "COPIES", copies)
    r = np.random.RandomState(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(100 + i, r.randn(4).tolist()) for i in range(40)]
    got = {x.id: list(x.near) for x in neighbours.nearest(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 5, 4).collect()}
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[59] == [0, 1, 2, 3, 4] and len(got) == 100


@pytest.mark.parametrize("copies", [5, 1000])
def test_many_unusable_vectors(spark, monkeypatch, copies):
    monkeypatch.setattr(neighbours, "COPIES", copies)
    r = np.random.RandomState(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(60)] + [(100 + i, r.randn(4).tolist()) for i in range(40)]
    zero, inf, nan = [0.0] * 4, float("inf"), float("nan")
    bad = [zero, [0.0, -0.0, 0.0, 0.0], [nan, 1.0, 2.0, 3.0], [1.0, inf, 2.0, 3.0], [1.0, -inf, 2.0, 3.0], [1.0, None, 2.0, 3.0], [1.0, 2.0, 3.0]]
    rows += [(1000 * (k + 1) + i, v) for k, v in enumerate(bad) for i in range(30)]
    got = {x.id: list(x.near) for x in neighbours.nearest(spark.createDataFrame(rows, "id long, v array<float>"), "id", "v", 5, 4).collect()}
    assert got[59] == [0, 1, 2, 3, 4] and set(got) == {*range(60), *range(100, 140)}
    assert all(set(near) <= set(got) for near in got.values())


def test_packing_of_vectors_is_lossless():
    h = np.random.RandomState(4).randn(50, 16).astype(np.float16)
    assert (neighbours._unpack(neighbours._pack(h), 16) == h).all()


# Problem 4


def _pairs(texts, shingles, t):
    sets = {i: shingles(x) for i, x in texts.items()}
    ids = sorted(i for i in sets if sets[i])
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def test_similar_equals_brute_force(spark):
    r = random.Random(6)
    base = [[r.choice("abcdefghijklmnop") + str(r.randint(0, 9)) for _ in range(r.randint(15, 60))] for _ in range(25)]
    texts = {}
    for k in range(160):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 2)] = [r.choice("xyz")] * r.randint(0, 2)
        texts[k] = r.choice([" ", "\n", "\t "]).join(w)
    texts |= {500: "", 501: "too short", 502: texts[0].upper(), 503: texts[0]}

    def shingles(x):
        w = x.lower().split()
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 20 else set()

    rows = [(i, x) for i, x in texts.items()] + [(0, texts[0]), (600, None), (None, texts[1])]
    df = spark.createDataFrame(rows, "id long, content string")
    links, members = similar.similar(df, "id", "content", 0.6, words=3, least=20)
    got = {tuple(x) for x in similar.pairs(members, links, "id").collect()}
    assert got == _pairs(texts, shingles, 0.6)
    c = {x.id: x for x in similar.classes(members, links, "id").collect()}
    assert c[502].class_id == c[503].class_id == 0 and 500 not in c and 600 not in c


def test_similar_paths_and_large_classes(spark):
    r = random.Random(7)
    texts = {i: "/srv/" + "".join(r.choice("ab") for _ in range(r.randint(3, 12))) for i in range(80)} | {200: "abc"}
    df = spark.createDataFrame(list(texts.items()), "id long, path string")
    links, members = similar.similar(df, "id", "path", 0.6, chars=4)
    assert {tuple(x) for x in similar.pairs(members, links, "id").collect()} == _pairs(texts, lambda x: {x[i : i + 4] for i in range(len(x) - 3)}, 0.6)
    same = spark.createDataFrame([(i, "the same path") for i in range(100)], "id long, path string")
    links, members = similar.similar(same, "id", "path", 0.6, chars=4)
    got = {tuple(x) for x in similar.pairs(members, links, "id").collect()}
    assert got == {(i, j) for j in range(64) for i in range(j)} | {(0, i) for i in range(64, 100)}
    links, members = similar.similar(df.limit(0), "id", "path", 0.6, chars=4)
    assert similar.pairs(members, links, "id").collect() == []
    with pytest.raises(ValueError):
        similar.similar(df, "id", "path", 0.6)


def test_different_texts_of_a_large_class_are_paired_out(spark):
    from tarnfold.llm import queries

    texts = {i: "The Same Path"[: i % 13] + "the same path"[i % 13 :].upper() if i < 70 else f"the {'same ' * (i - 68)}path" for i in range(75)}
    texts |= {100 + i: "the same path" for i in range(66)} | {200: "the same paths"}
    shingles = lambda x: {x.lower()[i : i + 4] for i in range(len(x) - 3)}
    want = {p for p in _pairs(texts, shingles, 0.6) if not {*p} & {164, 165}} | {(100, 164), (100, 165)}
    links, members = similar.similar(spark.createDataFrame(list(texts.items()), "id long, path string"), "id", "path", 0.6, chars=4)
    assert {tuple(x) for x in similar.pairs(members, links, "id").collect()} == want
    assert "p4_path_classes" in queries.queries()


def test_thresholds_are_the_cheapest_allocation():
    import itertools

    r = np.random.RandomState(9)
    for _ in range(40):
        groups, steps = r.randint(1, 5), 3
        cost = np.cumsum(r.randint(1, 9, (1, groups, steps)), 2).astype(np.float32)
        cost[0, r.randint(groups), 1:] = np.inf
        need = np.asarray([r.randint(1, groups * steps + 2)])
        price = lambda units: sum(0 if u == 0 else cost[0, g, u - 1] for g, u in enumerate(units))
        best = min((price(u) for u in itertools.product(range(steps + 1), repeat=groups) if sum(u) >= need[0]), default=np.inf)
        got = similar.allocate(cost, need)[0]
        assert (got == -1).all() if not np.isfinite(best) else got.sum() >= need[0] and price(got) == best


@pytest.mark.skipif(not pytest.importorskip("os").path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_near_duplicates_equal_sql(spark):
    import duckdb

    from tarnfold.llm import queries

    con, d = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("chunks", "files"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["p4_found"]).fetchall())
    assert sorted(tuple(r) for r in queries.p4_found(spark, d).collect()) == want


# Problem 7


def test_transducer():
    r = random.Random(8)
    words = sorted({bytes(r.choice(b"abc\xc3") for _ in range(r.randint(1, 6))) for _ in range(500)})
    data = transducer.compile_words((w, [k, k + 1][: 1 + k % 2]) for k, w in enumerate(words))
    t = transducer.Transducer(data)
    assert t.numbers(words).tolist() == list(range(len(words)))
    assert all(t.outputs(k).tolist() == [k, k + 1][: 1 + k % 2] for k in range(len(words)))
    others = [w + b"zz" for w in words[:50]] + [b"", b"q"]
    assert (t.numbers(others) == -1).all()
    assert len(t.final) < sum(map(len, words)) / 2
    assert (transducer.Transducer(transducer.compile_words([])).numbers([b"a"]) == -1).all()


@needs_files
def test_encoding_equals_the_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{vocabulary.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    r = random.Random(9)
    texts = ["", None, "Hello world", "  two\n\n  x\t y ", "<|endoftext|>", "½ ² ① é \x1c\x1d a\x85b", "中文、日本語。🗂️👩‍👧", "a" * 1000, "it's we'll 12345 ___ !!! --\r\n"] + ["".join(r.choice("ab'st 12 _-.\n\t é²　\x1f中🗂") for _ in range(r.randint(0, 200))) for _ in range(80)]
    df = spark.createDataFrame([(i, x, 0) for i, x in enumerate(texts)], "id long, text string, ids int")
    got = {x.id: list(x.ids) for x in encoding.encode(df, "id", "text").collect()}
    assert got == {i: t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(texts)}
    sizes = {x.id: x.n_tokens for x in encoding.token_counts(df, "id", "text").collect()}
    assert sizes == {i: len(v) for i, v in got.items()}
    ranks = vocabulary.byte_ranks()
    long = bytes(r.choice(b"abcde ") for _ in range(300))
    assert encoding._merge_long(long[:200], ranks) == encoding.merge(long[:200], ranks)


# Problem 8


def test_fill_is_the_best_subset_sum():
    r = random.Random(10)
    for _ in range(60):
        counts = {r.randint(1, 40): r.randint(1, 3) for _ in range(6)}
        room = r.randint(1, 90)
        sums = {0}
        for s, n in counts.items():
            sums = {x + s * k for x in sums for k in range(n + 1)}
        used = packing.fill(counts, room)
        assert all(used[s] <= counts[s] for s in used)
        assert sum(s * n for s, n in used.items()) == max(x for x in sums if x <= room)


def test_pack(spark):
    r = random.Random(11)
    sizes = {i: r.choice([0, 3, 17, 40, 64, 100, 130, 333]) for i in range(400)} | {900: None}
    df = spark.createDataFrame(list(sizes.items()) + [(0, sizes[0])], "id long, n int")
    got = packing.pack(df, "id", "n", 100).collect()
    twice = [x.piece_index for x in got if x.id == 0]
    assert sorted(twice) == sorted(2 * list(set(twice)))
    total = {}
    for x in got:
        total[x.container_id] = total.get(x.container_id, 0) + x.size
    assert max(total.values()) <= 100
    items = sum(v or 0 for v in sizes.values()) + (sizes[0] or 0)
    assert sum(total.values()) == items and len(total) <= -(-items // 100) + 12
    whole = {}
    for x in got:
        whole.setdefault(x.id, []).append((x.piece_index, x.size))
    assert all(len(v) == 1 or sizes[i] > 100 or i == 0 for i, v in whole.items())
    assert packing.pack(df.limit(0), "id", "n").collect() == []


# Problem 9

SAMPLES = [("en", "The old barn contains its glossary and the count looks odd."), ("en", "This search hides the empty envelope near the entrance."), ("de", "Die Schublade zeigt das rote Fähnchen trotz des Regens."), ("de", "Der Ordner enthält eine ältere Fassung für die nächste Woche."), ("fr", "Le tiroir du bas cache la liste des invités à côté de l'entrée."), ("fr", "La copie précède le début du récit avant la fin de semaine."), ("zh", "小型索引在上面的架子上重复了第二个章节。"), ("zh", "这次搜索在周末之前隐藏了港口的图片。")]


@needs_files
def test_forward_sums_all_segmentations():
    table, langs = languages.fit(SAMPLES)
    m = languages.Model(table, langs, None)

    def all_ways(w):
        if not w:
            return np.ones(len(langs))
        out = np.zeros(len(langs))
        for j in range(1, len(w) + 1):
            k = m.pieces.get(w[:j])
            if k is not None:
                out = out + table[k] * all_ways(w[j:])
        return out

    for w in ("▁barn", "▁rote", "索引"):
        assert np.allclose(m.word(w), np.log(all_ways(w)))
    assert np.isfinite(m.word("▁" + "x" * 500)).all() and np.isfinite(m.word("▁ʘ")).all()
    with pytest.raises(ValueError):
        languages.fit([])


@needs_files
def test_languages_of_texts(spark):
    samples = spark.createDataFrame([(i, *s) for i, s in enumerate(SAMPLES)], "sample_id long, lang string, text string")
    mixed = "The barn contains the empty envelope. Die Schublade enthält das rote Fähnchen."
    rows = [(1, mixed, "x"), (2, "这次搜索重复了第二个章节。", "x"), (3, None, "x"), (4, "", "x"), (5, "x_1 = 5 foo.bar", "x"), (6, "1.5, 2.5, 3.5.", "x"), (7, "Le début du récit cache la liste des invités.", "x")]
    df = spark.createDataFrame(rows, "id long, text string, lang string")
    assert {(r.id, r.lang) for r in languages.spoken(df, "id", "text", samples).collect()} == {(1, "en"), (1, "de"), (2, "zh"), (7, "fr")}
    seg = [(r.segment, r.lang, mixed[r.start_offset : r.end_offset].strip()) for r in languages.segments(df, "id", "text", samples).where("id = 1").orderBy("segment").collect()]
    assert seg == [(0, "en", mixed[:37]), (1, "de", mixed[38:])]


def test_labels(spark):
    from pyspark.sql import functions as F

    rows = ["en", "EN-gb", "en_us", "English", "ger", "zh-Hans-CN", "  fr ", None, "", "??", "unknown", "und", "n/a", "German-x"]
    df = spark.createDataFrame([(x,) for x in rows], "l string")
    assert [r[0] for r in df.select(languages.named(F.col("l"))).collect()] == ["en", "en", "en", "en", "de", "zh", "fr", None, None, None, None, None, None, None]


def test_gradients_of_the_tagger():
    p = {k: v.astype(np.float64) for k, v in bilstm.initial(7, 2, 3, 3, seed=5).items()}
    r = np.random.RandomState(6)
    chars, features, labels = r.randint(0, 7, (5, 4)), (r.rand(5, 4, 2) > 0.5).astype(np.uint8), r.randint(0, 3, (5, 4))
    value, g = bilstm.loss(p, chars, features, labels)
    for k in p:
        at = tuple(r.randint(0, n) for n in p[k].shape)
        old = p[k][at]
        p[k][at] = old + 1e-2
        up = bilstm.loss(p, chars, features, labels)[0]
        p[k][at] = old - 1e-2
        down = bilstm.loss(p, chars, features, labels)[0]
        p[k][at] = old
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3, k
    s = bilstm.scores(p, chars, features)
    best = bilstm.viterbi(s, p["t"])
    import itertools

    for b in range(4):
        paths = list(itertools.product(range(3), repeat=5))
        score = [sum(s[t, b, x[t]] for t in range(5)) + sum(p["t"][x[t], x[t + 1]] for t in range(4)) for x in paths]
        assert tuple(best[:, b]) == paths[int(np.argmax(score))]
