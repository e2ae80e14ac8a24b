"""Every stage of the pipeline against a brute-force version of its own."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import Counter

import corpus_pipeline
import pytest
from ledgerloom.llm import near_copies, packing, simhash
from ledgerloom.llm.workspace import shared_dir, written
from test_operators import brute_removed, brute_repeats, words


def good(text):
    """Whether no quality rule rejects a text."""
    text, w = text or "", words(text)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
    n, chars = len(w), sum(len(x.decode()) for x in w)
    if n < 50 or 2 * brute_repeats(w) > n or not 3 * n <= chars <= 10 * n:
        return False
    return 10 * sum(map(text.count, "#*$%&|<>")) <= n and 10 * text.count("!") <= 3 * n and 10 * (len(lines) - len(set(lines))) <= 4 * len(lines) and 5 * sum(map(bytes.__eq__, w, w[1:])) <= n


def test_stages_do_what_they_say(spark, docs, rows):
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "substring dedup", "mixing to target weights", "packing"]

    kept = stages["quality rules"](spark, docs, "").collect()
    assert Counter(map(tuple, kept)) == Counter(r for r in rows if good(r[1]))

    single = stages["simhash near-dedup"](spark, docs, "").collect()
    groups = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert Counter(r["doc_id"] for r in single if r["doc_id"] is not None) == Counter(g for g in groups if g is not None)

    cut = stages["substring dedup"](spark, docs, "")
    assert cut.columns == docs.columns
    assert Counter((r["doc_id"], tuple(words(r["text"]))) for r in cut.collect()) == Counter((i, tuple(x for k, x in enumerate(w) if k not in gone)) for i, w, gone in brute_removed(rows))


def brute_mixture(rows):
    """Copies in training order: ``(position, doc_id, copy, words)``."""
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s))
    sizes = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    slope = {s: (-0.5, 0.0, 0.5)[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        full = {s for s in free if share[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in full} or share
        left -= sum(2 * sizes[s] for s in full)
        free = free - full if full else set()
    out = []
    for source in sources:
        own = [r for r in rows if r[3] == source]
        own.sort(key=lambda r: (hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest(), len(words(r[1]))))
        before, wanted, d = 0, round(target[source]), slope[source]
        for copy in range(3):
            for r in own:
                w = words(r[1])[: max(0, wanted - before)]
                if w:
                    share = min(before / target[source], 1)
                    at = share if d == 0 else (math.sqrt((1 - d) ** 2 + 4 * d * share) - (1 - d)) / (2 * d)
                    out.append((at, r[0], copy, tuple(w)))
                before += len(words(r[1]))
    return sorted(out, key=lambda x: (round(x[0], 9), x[1] is not None, x[1], x[2]))


def test_the_mixture_is_in_training_order_and_sequences_follow_it(spark, docs, rows):
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns
    want = brute_mixture(rows)
    got = [(r["doc_id"], tuple(words(r["text"]))) for r in mixed.collect()]
    assert got == [(i, w) for _, i, _, w in want]

    table = written(mixed, "mixed")
    packed = corpus_pipeline.packed(spark, table, "").collect()
    assert all(0 < r["length"] <= 2048 for r in packed)
    tasks = {}
    for r in packed:
        tasks.setdefault((r["doc_id"], r["doc_tokens"]), set()).add(r["sequence_id"] >> 40)
    encode = packing.byte_bpe_50k()
    order = [tasks[r["doc_id"], len(encode(r["text"] or "")) // 4 + 1] for r in mixed.collect()]
    assert len({t for of in tasks.values() for t in of}) > 1
    assert all(min(a) <= max(b) for n, b in enumerate(order) for a in order[:n])


def test_stages_take_empty_tables_and_run_leaves_only_its_result(spark, none, rows, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, "")
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
    folder = shared_dir(spark).removeprefix("file://")
    spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    assert [name.startswith("pipeline-packing") for name in set(os.listdir(folder)) - before] == [True]


def five_word_sets(text):
    w = [x.lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("tile_rows", [512, 4])
def test_near_dedup_finds_all_documents_alike_by_four_fifths(spark, rows, tile_rows):
    rng = random.Random(3)
    table = [(r[0], r[1]) for r in rows]
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.randint(50, 160))
        for copy in range(8):
            changed = list(base)
            for place in rng.sample(range(len(base)), copy * len(base) // 160):
                changed[place] = rng.choice(vocabulary)
            table.append((1000 + 10 * family + copy, " ".join(changed)))
    sets = [(i, five_word_sets(t)) for i, t in table if i is not None]
    group = {i: i for i, _ in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    met = 0
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a == b or 10 * len(a & b) >= 8 * len(a | b):
                met += a != b
                group[max(root(i), root(j))] = min(root(i), root(j))
    assert met > 40
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    found = near_copies.near_copies(docs, tile_rows=tile_rows)
    assert Counter(map(tuple, found.collect())) == Counter((i, root(i)) for i, _ in sets)
    if tile_rows == 512:  # the stage joins what fingerprints link as well
        for r in simhash.near_duplicates(docs).filter("doc_id is not null").collect():
            a, b = root(r["doc_id"]), root(r["component_id"])
            group[max(a, b)] = min(a, b)
        kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
        assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted({root(i) for i, _ in sets})
