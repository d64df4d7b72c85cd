"""The operators against brute force, exact round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docquarry.llm import common, embedding_dedup, exact_dedup, mixing, packing, quality, simhash, substring_dedup, suffix_dedup, warc
from docquarry.llm.queries import oracle_sql, queries
from tests.compare import connect, rows


@pytest.fixture(scope="module")
def docs(spark, small):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]


def frame(spark, data, kind="doc_id long, text string"):
    return spark.createDataFrame(data, kind).repartition(4)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, small, name):
    df, want = queries()[name](spark, small), connect(small).sql(oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def components(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {n: root(n) for n in nodes}


def test_connected_components(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 400), draw.randint(0, 400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5200)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == components(nodes, [e for e in edges if e[0] != e[1]])


def plain_exact(batches, keep):
    """For each batch the rows that exact_dedup should give, all texts so far in mind."""
    pick, groups, out = {"smallest": min, "largest": max}[keep], defaultdict(list), []
    for batch in batches:
        for d, t in batch:
            groups["".join(c.lower() if c.isascii() else c for c in t or "")].append(d)
        now = Counter()
        for d, t in batch:
            body = "".join(c.lower() if c.isascii() else c for c in t or "")
            ids = [x for x in groups[body] if x is not None]
            stays = pick(ids) if ids else None
            now[d, stays, len(groups[body]), d == stays, hashlib.sha256(body.encode()).hexdigest()] += 1
        out.append(now)
    return out


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_batches_against_an_index(spark, tmp_path, keep):
    draw = random.Random(9)
    text = lambda: draw.choice(["same", "SAME", "", None, "é" * 30, *(f"text {k}" for k in range(40))])
    batches = [[(1, "same"), (2, "same"), (3, "x")], [(4, "other"), (5, "x")], [], *([(draw.choice([None, draw.randint(0, 500)]), text()) for _ in range(40)] for _ in range(4)), [(3, "x"), (7, "x")]]
    index = f"file:{tmp_path}/index"
    for batch, want in zip(batches, plain_exact(batches, keep), strict=True):
        got = exact_dedup.exact_dedup(frame(spark, batch), keep=keep, index=index).collect()
        assert Counter(tuple(r) for r in got) == want
    runs = exact_dedup.DigestIndex(spark, index).state()[2]
    assert Counter(r.level for r in runs) == {1: 2}  # eight batches, four runs of level 0 to one of level 1
    with pytest.raises(ValueError, match="keeps the"):
        exact_dedup.exact_dedup(frame(spark, batches[0]), keep="largest" if keep == "smallest" else "smallest", index=index)


def test_filters_let_all_entries_through(spark):
    entries = spark.range(5000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    others = spark.range(5000, 25_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    for rows in (exact_dedup.filter_rows(5000), 1):
        bitmap = exact_dedup.build_filter(entries, rows)
        assert exact_dedup.probe(entries, bitmap, rows).count() == 5000 and exact_dedup.probe(entries, bitmap, rows, outside=True).count() == 0
        passed = exact_dedup.probe(others, bitmap, rows).count()
        assert passed + exact_dedup.probe(others, bitmap, rows, outside=True).count() == 20_000
        assert rows == 1 or passed < 0.1 * 20_000


def test_two_texts_under_one_digest_stop_the_job(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "digest_of", lambda c: F.unhex(F.sha2(F.substring(exact_dedup.normalised(c), 1, 1), 256)))
    with pytest.raises(Exception, match="share a SHA-256 digest"):
        exact_dedup.exact_dedup(frame(spark, [(1, "ab"), (2, "ac")])).collect()


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def test_simhash_against_all_pairs(spark, docs):
    data = docs + [(9000, None), (9001, " "), (9002, "Solo"), (9003, "solo"), (9004, "a b"), (9005, docs[0][1] + " end")]
    fp = {d: plain_fingerprint(t) for d, t in data}
    ids = sorted(fp)
    want = components(ids, [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = simhash.simhash_components(frame(spark, data)).collect()
    assert {r["doc"]: r["fp"] % 2**64 for r in got} == fp and {r["doc"]: r["component_id"] for r in got} == want


def test_links_at_every_distance(spark):
    base = 0x0123456789ABCDEF
    prints = [base, base ^ 1, base ^ 3, base ^ (1 << 63) ^ 2, base ^ (0b111 << 20), base ^ (0b11111 << 20)]
    signed = [(p - 2**64 if p >> 63 else p,) for p in prints]
    got = simhash.ball_links(spark.createDataFrame(signed, "fp long")).collect()
    near = components([p for p, in signed], [(r["fp"], r["other"]) for r in got])
    want = components([p for p, in signed], [(a, b) for a, in signed for b, in signed if ((a ^ b) % 2**64).bit_count() <= 2])
    assert near == want


def test_quality_on_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in quality.query(spark, folder).collect() if r["doc_id"] in labels]
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.95


def test_context_vectors_count_whole_numbers(spark):
    data = [(1, "red fox red"), (2, "fox"), (3, ""), (4, None), (5, "a b c d e f g " * 9)]
    bins, index = quality._Bins(), quality.index_vectors().astype(int)
    want = np.zeros((quality.BINS, quality.DIMS), int)
    for _, text in data:
        line = quality.tokens((text or "").encode(), bins)
        for i, here in enumerate(line):
            for step in range(1, 2 * quality.REACH + 1):
                for j in (i - step, i + step):
                    if 0 <= j < len(line):
                        want[here] += index[line[j]]
    norm = np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1)
    df = spark.createDataFrame(data, "doc_id long, text string")
    for layout in (df.coalesce(1), df.repartition(5)):  # texts are apart, so the layout of the table makes no difference
        assert (quality.context_vectors(layout, "doc_id", "text") == want / norm).all()


def test_scores_do_not_depend_on_the_layout(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "quality")
    got = []
    for layout in (docs.coalesce(1), docs.repartition(7)):
        model = quality.fit(layout, labels)
        got.append({r["doc"]: r["score"] for r in quality.score(layout, model).collect()})
    assert got[0] == got[1] and len(got[0]) == docs.count()
    bins = quality._Bins()
    for doc, text in docs.limit(40).collect():  # the score by hand: mean vector, two layers, temperature
        seq = quality.tokens((text or "").encode(), bins)
        x = np.append(sum((model.table[b] for b in seq), np.zeros(model.table.shape[1])) / max(1, len(seq)), np.log1p(len(seq)))
        z = (x - model.centre) / model.spread * len(seq) / (len(seq) + quality.DOUBT)
        logit = sum(np.tanh(z @ model.w1[:, h] + model.b1[h]) * model.w2[h] for h in range(len(model.w2))) + model.b2
        assert got[0][doc] == pytest.approx(1 / (1 + np.exp(-logit / model.temperature)), abs=1e-9)


def test_a_fit_takes_no_more_rows_than_its_bound(spark, monkeypatch):
    rows = [(1, f"good text number {k}") for k in range(3000)] + [(k, "bad spam") for k in range(2, 60)]
    seen = []
    monkeypatch.setattr(quality, "fit_network", lambda table, x, y, part: seen.append(len(x)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 60)], "doc_id long, quality int")
    quality.fit(df, labels, fit_rows=50)
    quality.fit(df, labels, fit_rows=40)
    assert all(n <= 50 for n in seen)


def test_network_and_temperature():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(9000, 6))
    x[:, -1] = np.log1p(draw.integers(20, 400, len(x)))
    y = ((x[:, 0] * x[:, 1] + 0.3 * draw.normal(size=len(x))) > 0).astype(float)  # no single layer separates these
    part = np.arange(len(x)) % 3 == 0
    model = quality.fit_network(np.zeros((1, 5)), x, y, part)
    assert np.mean((model.probability(x[part]) >= 0.5) == y[part]) > 0.8
    logits = model.logits(x[part])
    plain = lambda t: -np.mean([np.log(1 / (1 + np.exp(-v / t))) if want else np.log(1 - 1 / (1 + np.exp(-v / t))) for v, want in zip(logits, y[part], strict=True)])
    assert plain(model.temperature) <= min(plain(t) for t in (0.3, 0.5, 0.8, 1.0, 1.3, 2.0, 4.0)) + 1e-3


@pytest.mark.parametrize("weights", [[1 / 3] * 3, [0.99985, 0.0001, 0.00005], [0.5], [0.3, 0.3, 0.2, 0.1, 0.1], "many", "uneven"])
def test_pfair_keeps_within_one_block(weights):
    """Against the given weights themselves, over 100,000 blocks and at every one of them."""
    draw = random.Random(1)
    if weights in ("many", "uneven"):
        weights = [draw.random() ** (3 if weights == "uneven" else 1) + 1e-6 for _ in range(60)]
    share = mixing.whole_weights(weights)
    total = sum(map(mixing.Fraction, weights))
    assert [mixing.Fraction(p, sum(share)) for p in share] == [mixing.Fraction(w) / total for w in weights]
    n = 100_000
    counts = [0] * len(weights)
    made, slot = mixing.pfair(share, [n] * len(weights), counts, 0, n)
    assert slot == n and [m[2] for m in made] == list(range(n))
    k = np.array([m[0] for m in made])
    for source, w in enumerate(weights):
        done = np.cumsum(k == source)
        assert np.abs(done - w / sum(weights) * np.arange(1, n + 1)).max() < 1
        assert [m[1] for m in made if m[0] == source] == list(range(counts[source]))


def test_epochs_give_the_same_schedule():
    draw = random.Random(6)
    for _ in range(30):
        n = draw.randint(1, 9)
        share, blocks = [draw.randint(1, 50) for _ in range(n)], [draw.randint(0, 60) for _ in range(n)]
        whole, _ = mixing.pfair(share, blocks, [0] * n, 0, sum(blocks))
        parts = [m for done, slot, counts in mixing.epochs(share, blocks, 7) for m in mixing.pfair(share, blocks, counts, slot, 7)[0]]
        assert parts == whole and Counter(m[:2] for m in whole) == Counter((k, j) for k in range(n) for j in range(blocks[k]))
        assert [m[2] for m in whole] == sorted({m[2] for m in whole})


def test_mixing_keeps_all_rows_and_the_targets(spark):
    data = [(k, "hot" if k % 3 else f"s{k % 7}" if k % 9 else None) for k in range(6000)] + [(5, "hot")]
    df = frame(spark, data, "doc_id long, source string").withColumn("a.b", F.lit(1)).withColumn("slot", F.lit("clash"))
    weights = {"hot": 0.5, None: 0.1, **{f"s{k}": 0.4 / 7 for k in range(7)}}
    got = mixing.mix_sources(df, weights, block_rows=4, epoch=100).select("row.doc_id", "source", "block", "slot", "turn", "place", "on_target").collect()
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter(data)
    assert len({(r["slot"], r["place"]) for r in got}) == len(got)
    assert {r["turn"] for r in got} == set(range(len({r["slot"] for r in got}))) and sorted(got, key=lambda r: r["slot"]) == sorted(got, key=lambda r: r["turn"])
    last = max(r["slot"] for r in got if r["on_target"])
    held = {s for _, s in data}
    exact = {s: mixing.Fraction(w) for s, w in weights.items()}
    total = sum(w for s, w in exact.items() if s in held)
    for source, w in exact.items():
        mine = sorted({r["slot"] for r in got if r["source"] == source})
        assert source not in held or max(mine) >= last
        for upto in range(0, last + 1):
            assert source not in held or abs(sum(s <= upto for s in mine) - (upto + 1) * w / total) < 1
    again = mixing.mix_sources(df.repartition(3), weights, block_rows=4, epoch=31).select("row.doc_id", "slot", "place").where("doc_id <> 5").collect()
    assert {(r["doc_id"], r["slot"]) for r in again} == {(r["doc_id"], r["slot"]) for r in got if r["doc_id"] != 5}
    assert mixing.in_mixed_order(df).columns == df.columns
    with pytest.raises(ValueError, match="positive"):
        mixing.mix_sources(df, {"hot": 0.0})


def test_packing_holds_every_token(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.default_vocabulary())
    data = docs + [(8000, "<|endoftext|> İΑΣ don't é\u0085x\x1c!"), (8001, " ".join(["ünïcode 12345"] * 3000))]
    ids = {d: [*whole.encode(t, add_special_tokens=False).ids, 1] for d, t in data}
    got = packing.pack(frame(spark, data), packing.default_vocabulary()).collect()
    cut = defaultdict(list)
    for r in got:
        part = ids[r["doc"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
        cut[r["sequence_id"]].append((r["offset"], r["length"]))
    assert Counter(r["doc"] for r in got) == Counter({d: -(-len(v) // 4096) for d, v in ids.items()})
    for parts in cut.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(cut) <= 1.02 * sum(map(len, ids.values())) / 4096 + 1


def test_plans_cover_any_histogram():
    draw = np.random.default_rng(3)
    for n, low, high in ((0, 1, 2), (1, 4096, 4097), (500, 1, 4097), (3000, 2100, 4097), (20000, 1, 200), (400, 1, 9)):
        have = np.bincount(draw.integers(low, high, n), minlength=4097)
        made, total = packing.plan(have), np.zeros(4097, int)
        for pattern, times in made:
            assert sum(s * t for s, t in pattern) <= 4096
            for s, t in pattern:
                total[s] += t * times
        assert (total == have).all()


@pytest.mark.parametrize("shape", ["long", "short", "mixed", "few"])
def test_most_tokens_go_by_fitted_patterns(shape):
    draw = np.random.default_rng(12)
    sizes = {"long": draw.integers(900, 4097, 6000), "short": draw.integers(3, 300, 30_000), "mixed": np.minimum(draw.lognormal(6, 1, 9000).astype(int) + 2, 4096), "few": draw.choice([7, 130, 512, 1000, 3000], 4000)}[shape]
    have = np.bincount(sizes, minlength=4097)
    fitted, left = packing.fitted(have)
    total, one_by_one = have.copy(), np.arange(4097)
    for pattern, times in fitted:
        for s, t in pattern:
            total[s] -= t * times
    assert (total == left).all() and (left >= 0).all()
    share, planned = 1 - left @ one_by_one / (have @ one_by_one), sum(n for _, n in packing.plan(have))
    if shape in ("short", "mixed"):
        assert share >= 0.9 and planned <= -(-(have @ one_by_one) // 4096) + 1


def test_counts_are_a_least_squares_fit():
    """Against the conditions of the optimum: no slope below zero, none above it where a count is above zero."""
    draw = np.random.default_rng(2)
    have = np.bincount(draw.integers(5, 100, 4000), minlength=101)
    made = packing.patterns(have, 100)
    x = packing.fit_counts(have, made, 100, rounds=200_000, still=1e-12)
    heavy = np.arange(101) / 100
    m = np.zeros((101, len(made)))
    for k, p in enumerate(made):
        for size in p:
            m[size, k] += heavy[size]
    slope = m.T @ (m @ x - have * heavy)
    scale = np.abs(m.T @ (have * heavy)).max()
    assert (x >= 0).all() and slope.min() > -1e-2 * scale and np.abs(slope * x).max() < 1e-2 * scale * x.max()


def test_archives_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 2000
    data = [(1, "http://a/1", big), (2, "http://a/2 b\n", big), (3, None, "short"), (4, "u", "short"), (5000, "u", big), (5, "u", None), (6, "u", "é" * 600), (2, "again", big)]
    df = frame(spark, data, "page_id long, url string, html string")
    folder = f"file:{tmp_path}/warc"
    manifest = warc.write_archives(df, folder, roll_bytes=300)
    assert manifest.count() > 2 and {f.name for f in (tmp_path / "warc").glob("*.gz")} == {r["file"] for r in manifest.collect()}
    got = Counter((r["page"], r["type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read_archives(manifest, folder).collect())
    want = Counter()
    for page, _, html in data:
        body = (html or "").encode()
        revisit = html == big and page != 5000
        want[page, "revisit" if revisit else "response", len(body), hashlib.sha1(body).hexdigest(), 5000 if revisit else None] += 1
    assert got == want
    twice = f"file:{tmp_path}/again"
    same = warc.write_archives(df.repartition(3), twice, roll_bytes=300)
    assert sorted(r["sha256"] for r in same.collect()) == sorted(r["sha256"] for r in manifest.collect())
    victim = next((tmp_path / "warc").glob("*.gz"))
    victim.write_bytes(victim.read_bytes()[:-5])
    with pytest.raises(Exception, match="not the file of the manifest"):
        warc.read_archives(manifest, folder).collect()


@pytest.mark.parametrize("ids", ["sparse", "dense", "null", "one"])
def test_files_hold_what_they_may(spark, tmp_path, ids):
    draw = random.Random(3)
    page = {"sparse": lambda k: draw.randrange(2**62), "dense": lambda k: k // 5, "null": lambda k: None, "one": lambda k: 7}[ids]
    body = lambda k: "same " * 250 if k % 3 == 0 else f"page {k} " + "".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 1800)))
    data = [(page(k), f"http://h/{k}", body(k)) for k in range(305)] + [(page(0), "http://h/0", "again " * 300)] * 400
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("a.b", F.lit(1)).withColumn("digest", F.lit("clash")).withColumn("shard", F.lit(2))
    size = 40_000
    folder = f"file:{tmp_path}/warc"
    manifest = warc.write_archives(df.repartition(5), folder, shard_bytes=size, roll_bytes=1 << 20)
    total = sum(len(h.encode()) + warc.RECORD_BYTES for *_, h in data)
    files = manifest.collect()
    assert len(files) <= -(-total // size) and max(r["records"] for r in files) <= 2 * size // warc.RECORD_BYTES
    same = warc.write_archives(df.repartition(2), f"file:{tmp_path}/again", shard_bytes=size, roll_bytes=1 << 20)
    assert sorted(r["sha256"] for r in same.collect()) == sorted(r["sha256"] for r in files)
    got = Counter((r["page"], r["type"], r["payload_digest"], r["refers_to"]) for r in warc.read_archives(manifest, folder).collect())
    groups = defaultdict(list)
    for p, _, h in data:
        groups[h].append(p)
    want = Counter()
    for p, _, h in data:
        known = [x for x in groups[h] if x is not None]
        first = max(known) if len(h) >= 1000 and len(groups[h]) > 1 and known else None
        revisit = first is not None and p != first
        want[p, "revisit" if revisit else "response", hashlib.sha1(h.encode()).hexdigest(), first if revisit else None] += 1
    assert got == want


@pytest.mark.parametrize("block", [4 << 20, 3 * 8 * 64])
def test_embeddings_against_all_pairs(spark, monkeypatch, block):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(60, 64))
    near = [c + draw.normal(size=64) * s for c in centres for s in (0.05, 0.1, 0.2, 0.24)]
    vectors = [v.tolist() for v in [*near, *draw.normal(size=(150, 64)), *(centres[0] + draw.normal(size=64) * 0.01 for _ in range(30))]]
    vectors += [vectors[3], vectors[3], [2 * x for x in vectors[5]], None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0] * 5]
    data = list(enumerate(vectors))
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", block)
    got = {r["vec"]: r for r in embedding_dedup.embedding_components(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    ok = [k for k, v in data if v and len(v) == 64 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.array([vectors[k] for k in ok], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    pairs = {(ok[a], ok[b]) for a, b in np.argwhere(m @ m.T >= 0.95) if a != b}
    links = Counter(a for a, _ in pairs)
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k, _ in data if k not in set(ok))
    found = sum(r["n_links"] for r in got.values())
    assert all(got[k]["n_links"] <= links[k] for k in ok) and found >= 0.95 * len(pairs)
    want = components(ok, pairs)
    assert np.mean([got[k]["component_id"] == want[k] for k in ok]) >= 0.95


@pytest.mark.parametrize("block", [4 << 20, 3 * 8 * 64])
def test_every_embedding_link_joins_its_component(spark, monkeypatch, block):
    draw = np.random.default_rng(7)

    def at(base, cosine, n):
        away = np.linalg.qr(np.column_stack([base, draw.normal(size=(64, n))]))[0][:, 1:].T
        return [(cosine * base + (1 - cosine**2) ** 0.5 * v).tolist() for v in away]

    bases = [v / np.linalg.norm(v) for v in draw.normal(size=(12, 64))]
    groups = [[*at(b, 0.972, 2 if k % 2 else 14), b.tolist()] for k, b in enumerate(bases)]  # leaves are 0.945 alike, the base comes last
    vectors = [v for g in groups for v in g]
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", block)
    data = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").coalesce(1)
    got = {r["vec"]: r for r in embedding_dedup.embedding_components(data).collect()}
    m = np.array(vectors)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    pairs = [(int(a), int(b)) for a, b in np.argwhere(m @ m.T >= 0.95) if a != b]
    full = Counter(a for a, _ in pairs)
    want = components(range(len(vectors)), pairs)
    met = {want[k] for k in want} - {want[k] for k in want if got[k]["n_links"] != full[k]}  # groups all of whose links were found
    assert len(met) >= 6
    for k, root in want.items():
        if root in met:
            assert got[k]["component_id"] == root and got[k]["kept"] == (k == root)
    assert all(got[k]["component_id"] != k or any(got[j]["component_id"] == k for j in got if j != k) for k in got if got[k]["n_links"])


def test_vectors_of_any_length_and_scale(spark):
    draw = np.random.default_rng(11)
    long = [v.tolist() for v in draw.normal(size=(4, 9))]
    eight = draw.normal(size=8)
    rows = [(1, eight.tolist()), (2, (eight * 1e200).tolist()), (3, long[0]), (4, [x * 1e-200 for x in long[0]]), (5, [1.0]), (6, [3.0]), (7, [-2.0]), (8, [float("nan")] * 30), (None, long[1]), (9, []), (9, [0.0] * 8), (10, [5e-324] + [0.0] * 7), (11, [1.0] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for clash in ("cid", "cell", "size", "vec", "digest", "a.b"):
        df = df.withColumn(clash, F.lit(clash))
    got = sorted((r["vec"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in embedding_dedup.embedding_components(df).collect())
    alone = [(0, 0, 0, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (9, 0, 9, True)]
    pairs = [(a + k, 1, a, k == 0) for a in (1, 3, 5, 10) for k in (0, 1)]
    assert got == sorted(alone + pairs)


def test_recall_of_the_embedding_query(spark, tmp_path):
    """All pairs of 4,000 vectors by brute force, through the query with its own parameters, by bands of cosine."""
    draw = np.random.default_rng(3)
    base = draw.normal(size=(1000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    cosines = draw.uniform(0.95, 1.0, size=(1000, 2))
    away = draw.normal(size=(1000, 2, 64))
    away -= (away * base[:, None]).sum(-1, keepdims=True) * base[:, None]
    away /= np.linalg.norm(away, axis=-1, keepdims=True)
    near = cosines[..., None] * base[:, None] + np.sqrt(1 - cosines**2)[..., None] * away
    m = np.concatenate([base, near.reshape(-1, 64), draw.normal(size=(1000, 64))])
    m = (m / np.linalg.norm(m, axis=1, keepdims=True))[draw.permutation(len(m))]
    path = tmp_path / "embeddings.parquet"
    spark.createDataFrame([(k, v) for k, v in enumerate(m.tolist())], "vec_id long, embedding array<double>").write.parquet(str(path))
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.query(spark, str(tmp_path)).collect()}
    alike = m @ m.T
    np.fill_diagonal(alike, 0)
    want = (alike >= 0.95).sum(1)
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.97 * want.sum()
    for low in (0.95, 0.96, 0.97, 0.98, 0.99):  # vectors whose links all lie in one band
        mine = np.flatnonzero((want > 0) & ((alike >= low) & (alike < low + 0.01)).sum(1) == want)
        assert sum(got[int(k)] for k in mine) >= 0.9 * want[mine].sum()


def plain_removal(data, span=200):
    seen, bodies = Counter(), [(d, (t or "").encode()) for d, t in data]
    for _, b in bodies:
        seen.update(b[j : j + span] for j in range(len(b) - span + 1))
    out = Counter()
    for d, b in bodies:
        gone = bytearray(len(b))
        for j in range(len(b) - span + 1):
            if seen[b[j : j + span]] > 1:
                gone[j : j + span] = b"\1" * span
        runs = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[d, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("group", [8192, 2])
def test_substrings_against_all_windows(spark, docs, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    shared = docs[5][1][:350]
    data = docs + [(9000, None), (9001, ""), (9002, "ab" * 700), (9003, "x" + "ab" * 300), (9004, docs[3][1]), (9004, docs[3][1]), (9005, "q" * 200), (9006, "q" * 199), *((9100 + k, f"{k} head {shared} tail {k}") for k in range(12))]
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(frame(spark, data)).drop("removed").collect())
    assert got == plain_removal(data)


def test_maximal_repeats():
    draw = random.Random(8)
    words = [bytes(draw.choice(b"ab") for _ in range(30)) for _ in range(4)]
    parts = [(w, len(w) - 3) for w in words]
    got = {(n, tuple(sorted(g))) for n, g in suffix_dedup.maximal_repeats(parts, 4)}
    starts = [(p, j) for p, (w, n) in enumerate(parts) for j in range(n)]
    want = set()
    for n in range(4, 31):
        by = defaultdict(list)
        for p, j in starts:
            if j + n <= len(words[p]):
                by[words[p][j : j + n]].append((p, j))
        for text, at in by.items():
            before = {words[p][j - 1] if j else -1 - p for p, j in at}
            after = {words[p][j + n] if j + n < len(words[p]) else -1 - p for p, j in at}
            if len(at) > 1 and len(before) > 1 and len(after) > 1:
                want.add((n, tuple(sorted(at))))
    assert got == want


def test_covered_spans_of_weighted_parts():
    draw = random.Random(18)
    for _ in range(60):
        words = list({bytes(draw.choice(b"ab") for _ in range(draw.randint(5, 24))) for _ in range(4)})
        weights = [draw.choice([1, 1, 1, 3]) for _ in words]
        parts = [(w, len(w) - 3) for w in words]
        seen = Counter()
        for (w, n), c in zip(parts, weights, strict=True):
            for j in range(n):
                seen[w[j : j + 4]] += c
        for (w, n), spans in zip(parts, suffix_dedup.covered(parts, weights, 4), strict=True):
            want = {x for j in range(n) if seen[w[j : j + 4]] > 1 for x in range(j, j + 4)}
            assert {x for a, b in spans for x in range(a, b)} == want


def test_periodic_text_is_scanned_in_linear_time():
    body = b"ab" * 4000
    started = time.perf_counter()
    spans = suffix_dedup.covered([(body, len(body) - 199)], [1])
    assert spans == [[(0, len(body))]] and time.perf_counter() - started < 20


def test_compact_windows_hold_every_passage():
    draw = np.random.default_rng(6)
    for n, t in ((60, 5), (200, 20), (30, 40), (50, 7)):
        h = draw.integers(0, 30 if n == 50 else 2**62, n).astype(np.uint64) << np.uint64(24)
        held = list(zip(*(x.tolist() for x in substring_dedup.compact_windows(h, t)), strict=True))
        for left in range(n):
            for right in range(left + t - 1, n):
                k = left + int(np.argmin(h[left : right + 1]))
                assert sum(a <= left <= m <= right <= b for a, m, b in held) == 1 and any(a <= left and m == k and right <= b for a, m, b in held)


def similarity(a, b):
    x, y = ({tuple(v[i : i + 5]) for i in range(len(v) - 4)} for v in (a, b))
    return len(x & y) / max(1, len(x | y))


def test_near_passages(spark):
    draw = random.Random(3)
    words = lambda n: ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 6))) for _ in range(n)]
    texts = {k: words(draw.randint(80, 400)) for k in range(120)}
    planted = []
    for k in range(1000, 1120, 2):
        passage = words(draw.choice([51, 60, 100, 200]))
        other = list(passage)
        if len(passage) >= 100 and k % 4 == 0:
            other[draw.randrange(len(other))] = "zz"
        texts[k], texts[k + 1] = words(draw.randint(0, 200)) + passage + words(draw.randint(0, 200)), words(draw.randint(0, 200)) + other + words(draw.randint(0, 200))
        planted.append({k, k + 1})
    common_passage = words(60)
    for k in range(5000, 5030):
        texts[k] = words(draw.randint(20, 100)) + common_passage + words(draw.randint(20, 100))
    texts |= {7000: ["spam"] * 400, 7001: ["spam"] * 400 + ["x"], 7002: texts[3], 7003: texts[3], 7004: words(30)}
    got = substring_dedup.near_passages(frame(spark, [(k, " ".join(v)) for k, v in texts.items()])).collect()
    pairs, ids = [{r["doc"], r["other"]} for r in got], {x for r in got for x in (r["doc"], r["other"])}
    assert sum(p in pairs for p in planted) >= 0.97 * len(planted)
    assert {*range(5000, 5030), 7000, 7001, 7002, 7003} <= ids and not ids & {*range(3), *range(4, 120), 7004}
    for r in got:
        x, y = texts[r["doc"]][r["start"] : r["stop"]], texts[r["other"]][r["other_start"] : r["other_stop"]]
        assert min(len(x), len(y)) >= 50 and similarity(x, y) == pytest.approx(r["similarity"]) and r["similarity"] >= 0.8


def test_recall_by_bands_of_similarity(spark):
    """Edited pairs, and families of edited copies, against all pairs that are alike: found, or linked through others."""
    draw = random.Random(1)
    word = lambda n: [f"w{draw.randrange(5000)}" for _ in range(n)]

    def edited(passage, n):
        out = list(passage)
        for _ in range(n):
            k = draw.randrange(len(out))
            out[k : k + 1] = draw.choice([[], [f"e{draw.randrange(5000)}"], [out[k], f"i{draw.randrange(5000)}"]])
        return out

    groups = []
    for _ in range(160):
        one = word(draw.randint(70, 250))
        groups.append([one, edited(one, draw.randint(1, max(1, len(one) // 40)))])
    for _ in range(25):
        one = word(120)
        groups.append([edited(one, draw.randint(0, 2)) for _ in range(8)])
    for _ in range(10):  # chains: each copy is an edit of the one before
        one, chain = word(110), []
        for _ in range(15):
            chain.append(one)
            one = edited(one, draw.randint(1, 2))
        groups.append(chain)
    ids = list(range(sum(map(len, groups))))
    draw.shuffle(ids)
    pairs, texts, kin = [], {}, {}
    for n, group in enumerate(groups):
        mine = [(ids.pop(), p) for p in group]
        kin |= dict.fromkeys((d for d, _ in mine), n)
        texts |= {d: word(draw.randint(0, 150)) + p + word(draw.randint(0, 150)) for d, p in mine}
        pairs += [(a, b, s) for i, (a, p) in enumerate(mine) for b, q in mine[i + 1 :] if min(len(p), len(q)) >= 50 and (s := similarity(p, q)) >= 0.8]
    got = substring_dedup.near_passages(frame(spark, [(d, " ".join(t)) for d, t in texts.items()])).collect()
    links = {(r["doc"], r["other"]) for r in got}
    root = components(texts, links)
    for low in (0.8, 0.85, 0.9, 0.95):
        band = [(a, b) for a, b, s in pairs if low <= s < low + 0.05 or s == 1 and low == 0.95]
        assert len(band) > 20 and sum(root[a] == root[b] for a, b in band) >= 0.97 * len(band)
    assert all(kin[a] == kin[b] for a, b in links)  # nothing else is linked


def test_passages_round_a_common_line_meet_without_a_representative(spark):
    """Pairs share 50 words of which 44 are a line that others have too: no representative of the line has the pair's passage."""
    draw = random.Random(12)
    word = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    texts, pairs = {}, []
    for _ in range(60):
        line = word(44)
        for _ in range(6):
            passage = [*word(3), *line, *word(3)]
            pairs.append((len(texts), len(texts) + 1))
            for _ in range(2):
                texts[len(texts)] = [*word(20), *passage, *word(20)]
    got = substring_dedup.near_passages(frame(spark, [(d, " ".join(t)) for d, t in texts.items()])).collect()
    assert {tuple(sorted((r["doc"], r["other"]))) for r in got} == set(pairs)
    assert all(similarity(texts[r["doc"]][r["start"] : r["stop"]], texts[r["other"]][r["other_start"] : r["other_stop"]]) >= 0.8 for r in got)


def test_prefixes_of_alike_stretches_meet():
    draw = np.random.default_rng(4)
    counts, far, met = draw.integers(0, 9, 1 << 16), substring_dedup._AROUND, 0
    for letters in (10**9, 30):
        for _ in range(400):
            one = draw.integers(0, letters, 60)
            two = one.copy()
            two[draw.choice(60, draw.integers(0, 4), replace=False)] = draw.integers(0, letters, 1)
            x, y = (substring_dedup.shingles(" ".join(f"v{v}" for v in w).encode()) for w in (one, two))
            k = int(draw.choice(np.flatnonzero(x == y))) if (x == y).any() else None
            alike = [j for j in range(11) if k is not None and j <= k < j + 46 and substring_dedup._alike(x[j : j + 46], y[j : j + 46]) >= 0.8]
            if not alike:
                continue
            found = []
            for s in (x, y):
                place = k + np.arange(-far, far + 1)[None]
                near, there = s[np.clip(place, 0, len(s) - 1)], (place >= 0) & (place < len(s))
                chosen, n, shared = substring_dedup.prefixes(near, there, counts)
                assert n[0] == len(set(near[there].tolist()))
                found.append((set(near[chosen].tolist()), shared[0], set(near[there].tolist())))
            met += 1
            assert found[0][0] & found[1][0] and len(found[0][2] & found[1][2]) >= max(found[0][1], found[1][1])
    assert met > 200


def test_edited_passages_against_brute_force():
    draw = np.random.default_rng(5)
    word = lambda n: [f"w{v}" for v in draw.integers(0, 10**9, n)]
    tried = 0
    for n in [*range(50, 96), 55, 55, 400, 400]:
        for edits in (1, 2, n // 60 + 1):
            one = word(n)
            two = list(one)
            for k in draw.choice(n, edits, replace=False):
                two[k] = "edited"
            if similarity(one, two) < 0.8:
                continue
            tried += 1
            left, right = [*word(draw.integers(0, 60)), *one, *word(draw.integers(0, 60))], [*word(draw.integers(0, 60)), *two, *word(draw.integers(0, 60))]
            got = substring_dedup.similar_passages(*(substring_dedup.shingles(" ".join(v).encode()) for v in (left, right)))
            assert got, (n, edits)
            for a, b, c, d, alike in got:
                assert b - a >= 46 and d - c >= 46 and alike >= 0.8 and similarity(left[a : b + 4], right[c : d + 4]) == pytest.approx(alike)
    assert tried > 80


def test_segments_against_all_segments():
    draw = np.random.default_rng(9)
    for n, share in ((30, 0.9), (60, 0.93), (120, 0.9), (200, 0.85)):
        for _ in range(40):
            hit = draw.random(n) < share
            total = np.concatenate(([0], np.cumsum(np.where(hit, 1, -8))))
            whole = [y - x for x in range(n) for y in range(x + 10, n + 1) if total[y] >= total[x]]
            ended = [y - x for x in range(n) for y in range(x + 10, n + 1) if total[y] >= total[x] and hit[x] and hit[y - 1]]
            got = substring_dedup.best_segments(hit, 10)
            assert bool(got) == bool(whole) and max([y - x for x, y in got], default=0) == max(ended, default=10 if whole else 0)
            assert all(total[y] >= total[x] for x, y in got)


def test_passages_over_a_cut(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_TREE", 300)
    monkeypatch.setattr(substring_dedup, "_OVERLAP", 120)
    draw = np.random.default_rng(2)
    word = lambda n: [f"w{v}" for v in draw.integers(0, 10**9, n)]
    passage = word(60)
    batch = [" ".join([*word(270), *passage, *word(200)]), " ".join([*word(20), *passage, *word(20)])]
    got = substring_dedup.near_passages(spark.createDataFrame(list(enumerate(batch)), "doc_id long, text string").coalesce(1)).collect()
    assert [(r["other_start"], r["other_stop"], r["start"], r["stop"]) for r in got] == [(270, 330, 20, 80)]
