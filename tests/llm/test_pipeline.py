"""Each stage on what the stage before it kept, against a plain version of its decision."""

from __future__ import annotations

import corpus_pipeline
import random

from docquarry.llm import mixing, quality, simhash
from docquarry.llm.common import materialize
from tests.llm.test_operators import components


def shingle_words(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def test_stages(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact", "near", "mix", "pack"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    one = materialize(stages["quality"](spark, docs, small), "t")
    scores = {r["doc_id"]: r["predicted"] for r in quality.query(spark, small).collect()}
    kept = {r["doc_id"] for r in one.collect()}
    assert kept == {d for d, p in scores.items() if p} and 0 < len(kept) < len(texts)

    two = materialize(stages["exact"](spark, one, small), "t")
    last = {}
    for d in sorted(kept):
        last["".join(c.lower() if c.isascii() else c for c in texts[d])] = d
    assert {r["doc_id"] for r in two.collect()} == set(last.values())

    three = materialize(stages["near"](spark, two, small), "t")
    ids = sorted(last.values())
    shingled = {d: shingle_words(texts[d]) for d in ids}
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if alike(shingled[a], shingled[b])]
    roots = components(ids, pairs)
    left = {r["doc_id"] for r in three.collect()}
    assert set(roots.values()) <= left <= set(ids)  # how many of the others go is measured below

    four = materialize(stages["mix"](spark, three, small), "t")
    assert four.columns == docs.columns and sorted(map(tuple, four.collect())) == sorted(map(tuple, three.collect()))

    five = stages["pack"](spark, four, small).collect()
    assert {r["doc_id"] for r in five} == left
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in five)


def test_packed_sequences_follow_the_mixture(spark):
    sources = ["hot"] * 3000 + ["a"] * 300 + ["b"] * 200
    data = [(k, s, f"{s} " + "some words " * (150 + k * 7919 % 200)) for k, s in enumerate(sources)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").repartition(4)
    turn = {r["doc_id"]: r["turn"] for r in mixing.with_turns(docs, "turn").collect()}
    got = corpus_pipeline.pack_stage(spark, docs, "").collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got) and {r["doc_id"] for r in got} == set(turn)
    packed = [r["doc_id"] for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))]
    mixed = sorted(turn, key=turn.get)
    for upto in range(500, 3500, 500):
        for source in ("hot", "a", "b"):
            one, two = (sum(sources[d] == source for d in order[:upto]) / upto for order in (packed, mixed))
            assert abs(one - two) < 0.08  # a stretch is followed as a whole; packing by hash is off by 0.17


def test_near_copies_against_all_pairs(spark):
    """Edited copies by bands of similarity, texts of one word, and a large family of copies of one another."""
    draw = random.Random(8)
    word = lambda n: [f"{draw.choice('abcdefgh')}{min(4000, int(draw.paretovariate(0.5)))}" for _ in range(n)]
    edited = lambda text, n: [draw.choice(["x", "y", "z"]) + str(draw.randrange(99)) if k in set(draw.sample(range(len(text)), n)) else w for k, w in enumerate(text)]
    texts = [word(draw.randint(1, 400)) for _ in range(60)]
    for _ in range(250):
        base = word(draw.randint(80, 500))
        texts += [base, edited(base, draw.randint(1, max(1, len(base) // 45)))]
    hot = word(200)
    texts += [edited(hot, draw.randint(0, 3)) for _ in range(150)]
    texts += [["spam"] * 300 + [f"tail{k}"] for k in range(40)] + [["spam"] * 300, [], [], ["one"], ["ONE"], ["a", "b"], ["b", "a"]]
    texts = [" ".join(t) for t in texts]
    order = list(range(len(texts)))
    draw.shuffle(order)
    data = [(order[k], t) for k, t in enumerate(texts)]
    shingled = {d: shingle_words(t) for d, t in data}
    ids = sorted(shingled)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if alike(shingled[a], shingled[b])]
    roots = components(ids, pairs)
    left = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string").repartition(5)).collect()}
    assert set(roots.values()) <= left  # no document goes that is like no other
    gone, should = len(ids) - len(left), len(ids) - len(set(roots.values()))
    assert gone >= 0.9 * should, (gone, should)


def test_near_recall_by_length_and_similarity(spark):
    """Pairs, not family members: for each length and band of similarity the share of planted pairs whose two texts fall into one group."""
    draw = random.Random(21)
    word = lambda: f"{draw.choice('abcdefghij')}{min(20000, int(draw.paretovariate(0.4)))}"
    lengths, bands = (20, 40, 80, 150, 300, 800, 2000), ((0.8, 0.85), (0.85, 0.9), (0.9, 1.0))
    texts, planted = [], {}
    for length in lengths:
        for band in bands:
            made = 0
            for _ in range(4000):
                if made == 24:
                    break
                base = [word() for _ in range(length)]
                copy = list(base)
                for _ in range(draw.randint(1, max(1, length // 25))):
                    at = draw.choice([0, len(copy) - 1, draw.randrange(len(copy)), draw.randrange(len(copy))])
                    kind = draw.random()
                    if kind < 0.6:
                        copy[at] = word()
                    elif kind < 0.8:
                        del copy[at]
                    else:
                        copy.insert(at, word())
                a, b = (shingle_words(" ".join(t)) for t in (base, copy))
                if a != b and band[0] <= len(a & b) / len(a | b) < band[1]:
                    planted[len(texts), len(texts) + 1] = length, band
                    texts += [" ".join(base), " ".join(copy)]
                    made += 1
    rows, links = simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    node = {r["doc"]: r["nid"] for r in rows.collect()}
    root = components(set(node.values()), [(r["member"], r["rep"]) for r in links.collect()])
    hit, total = {}, {}
    for (a, b), (length, band) in planted.items():
        for key in (length, band):
            total[key] = total.get(key, 0) + 1
            hit[key] = hit.get(key, 0) + (root[node[a]] == root[node[b]])
    shares = {k: hit[k] / total[k] for k in total}
    assert all(total[k] >= 20 for k in lengths) and all(s >= 0.9 for s in shares.values()), shares


def test_a_member_unlike_the_first_meets_another(spark):
    """Many texts with one common opening, in which each second text has an edited copy."""
    draw = random.Random(4)
    head = [f"licence{k}" for k in range(60)]
    texts = []
    for _ in range(120):
        body = [f"w{draw.randrange(3000)}" for _ in range(60)]
        texts += [head + body, head + body[:30] + ["changed"] + body[31:]]
    rows, links = simhash.near_copies(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3))
    node = {r["doc"]: r["nid"] for r in rows.collect()}
    root = components(set(node.values()), [(r["member"], r["rep"]) for r in links.collect()])
    joined = sum(root[node[k]] == root[node[k + 1]] for k in range(0, 240, 2))
    assert joined >= 108 and len({root[node[k]] for k in range(0, 240, 2)}) == 120


def test_near_texts_of_one_base_lose_no_link(spark):
    """Two edits put most pairs of a family below the similarity: first texts of buckets are unlike many, and what is alike among these must be found too."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    texts = {}
    for d in range(80):
        words = list(base)
        for k in rng.sample(range(120), 2):
            words[k] = f"e{d}x{k}"
        texts[d] = " ".join(words)
    shingled = {d: shingle_words(t) for d, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and alike(shingled[a], shingled[b])]
    roots = components(list(texts), pairs)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    left = {r["doc_id"] for r in simhash.drop_near_copies(docs).collect()}
    assert left == set(roots.values())


def test_near_rounds_hold_labels(spark):
    """Components are carried from round to round: labels are those of all links, and a run plans fewer jobs than if each round began anew."""
    rng = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for d in range(60):
        words = list(base)
        for k in rng.sample(range(120), 2):
            words[k] = f"e{d}x{k}"
        texts.append(" ".join(words))
    runs = lambda: spark._jsparkSession.sharedState().statusStore().executionsCount()
    before = runs()
    rows, links, labels = simhash._near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4), "doc_id", "text")
    assert runs() - before < 66
    node = {r["doc"]: r["nid"] for r in rows.collect()}
    root = components(set(node.values()), [(r["member"], r["rep"]) for r in links.collect()])
    label = {r["nid"]: r["label"] for r in labels.collect()}
    assert len(label) and {n: label.get(n, n) for n in root} == root


def test_labels_after_more_links(spark):
    made = lambda pairs: spark.createDataFrame(pairs, "member long, rep long")
    first, second, third = [(2, 1), (5, 4), (5, 3)], [(7, 6), (4, 2), (9, 7)], [(9, 1), (11, 10)]
    labels = None
    for found in (first, second, [], third):
        labels = simhash._relabelled(labels, made(found))
    assert {r["nid"]: r["label"] for r in labels.collect()} == {**{n: 1 for n in (1, 2, 3, 4, 5, 6, 7, 9)}, 10: 10, 11: 10} and labels.count() == 10


def test_near_pairs_of_a_family_grow_with_its_size(spark, monkeypatch):
    """Texts of one base, three or four edits from it and so unlike one another, some with an edited copy: no link is lost, and what is compared goes with the texts and not with their square."""
    rng = random.Random(9)
    edits = lambda words, d, n: [f"e{d}x{k}" if k in places else w for places in [set(rng.sample(range(150), n))] for k, w in enumerate(words)]
    base = [f"w{k}" for k in range(150)]
    data = []
    for d in range(0, 320, 2):
        one = edits(base, d, rng.choice([3, 4]))
        data += [(d, " ".join(one)), (d + 1, " ".join(edits(one, d + 1, 1 if d % 8 == 0 else 4)))]
    shingled = {d: shingle_words(t) for d, t in data}
    roots = components(list(shingled), [(a, b) for a in shingled for b in shingled if a < b and alike(shingled[a], shingled[b])])
    counts, written = {}, simhash.materialize

    def counted(df, label, *more):
        out = written(df, label, *more)
        counts.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialize", counted)
    left = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()}
    assert left == set(roots.values()) and 10 < len(data) - len(left)
    assert sum(counts["near-pairs"] + counts["near-rest"]) < 8 * len(data), counts
