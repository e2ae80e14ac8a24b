"""Each operator against a brute-force version on a small table of awkward rows, and on an empty table."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import classifier, fingerprints, html_text, licenses, mixing, packing, quality_rules, simhash, substrings, token_counts


def words(text):
    return (text or "").encode().split()


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(v >> bit & 1 for v in values) > len(values))


def test_simhash_links_like_brute_force(docs, rows):
    got = simhash.near_duplicates(docs, tile_rows=8, parts=2).collect()
    prints = [brute_fingerprint(r[1]) for r in rows]
    want = Counter((r[0], p) for r, p in zip(rows, prints, strict=True))
    assert Counter((r["doc_id"], r["bits"] & (1 << 64) - 1) for r in got) == want
    named = [(r[0], p) for r, p in zip(rows, prints, strict=True) if r[0] is not None]
    parent = {i: i for i, _ in named}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in named:
        for j, q in named:
            if (p ^ q).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert all(r["component_id"] == (None if r["doc_id"] is None else find(r["doc_id"])) for r in got)


@pytest.mark.parametrize("parts", [4, 8])
def test_finer_tiles_lose_no_link(spark, parts):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.int64)
    close = [int(b) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63))) for b in base for _ in range(3)]
    bits = sorted({*map(int, base), *close})
    nodes = spark.createDataFrame([(b, i) for i, b in enumerate(bits)], "bits long, node long")
    found = {tuple(sorted((r["node"], r["component"]))) for r in simhash.components(simhash.links(nodes, parts=parts, tile_rows=7)).collect()}
    parent = list(range(len(bits)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(bits):
        for j in range(i):
            if (p ^ bits[j]).bit_count() <= 2 and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert found == {tuple(sorted((i, find(i)))) for i in range(len(bits)) if Counter(map(find, range(len(bits))))[find(i)] > 1}


def test_packing_is_an_exact_cover(docs, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs, capacity=128, max_open=4).collect()
    pieces = sorted((str(r["doc_id"]), r["doc_tokens"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    ids = {}
    for r in rows:
        tokens = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        ids.setdefault((str(r[0]), len(tokens)), []).append(tokens)
    assert sum(p[3] for p in pieces) == sum(len(t) for group in ids.values() for t in group)
    for doc, n, start, length, crc in pieces:
        assert any(zlib.crc32(np.array(t[start : start + length], "<u4").tobytes()) == crc for t in ids[doc, n])
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
        short += at < 128
    assert short <= 3  # one for each input partition


def test_sum_of_squares_level_is_the_best_one():
    packer = packing.SumOfSquaresPacker(20, 100)
    rng = np.random.default_rng(1)
    for size in rng.integers(1, 20, 200):
        n = packer.counts.copy()
        costs = {}
        for h in range(0, 20 - int(size) + 1):
            if h == 0 or n[h]:
                m = n.copy()
                m[h] -= h > 0
                if h + size < 20:
                    m[h + size] += 1
                costs[h] = int((m[1:20] ** 2).sum())
        level = packer.level(int(size))
        assert costs[level] == min(costs.values())
        costs.pop(0)
        level = packer.level(int(size), new=False)
        assert costs[level] == min(costs.values()) if costs else level == 0
        list(packer.add((0, 0), np.ones(size, "<u4")))


def test_sequences_follow_an_order(spark):
    rng = np.random.default_rng(2)
    place = rng.permutation(400).tolist()
    table = spark.createDataFrame([(i, f"{'word ' * (1 + p % 37)}", p) for i, p in enumerate(place)], "doc_id long, text string, place long").repartition(5)
    got = packing.pack(table, capacity=64, order=[F.col("place")]).collect()
    first = {r["doc_id"]: r["sequence_id"] >> 40 for r in got}
    by_place = [first[i] for i in sorted(first, key=lambda i: place[i])]
    assert len(first) == 400 and by_place == sorted(by_place) and by_place[-1] > 0


def test_few_sequences_are_emptied_and_one_is_short():
    rng = np.random.default_rng(5)
    packer = packing.SumOfSquaresPacker(2048, 4096)
    full = [s for n in rng.integers(1, 1500, 4000) for s in packer.add((0, int(n)), np.ones(int(n), "<u4"))]
    last = list(packer.finish())
    assert sum(sum(len(ids) for _, _, ids in s) < 2048 for s in full + last) == 1
    assert packer.n_emptied < 0.15 * len(full + last)


def test_token_ids_equal_the_reference_tokenizer(rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.byte_bpe_50k()
    for text in [*(r[1] or "" for r in rows), "a  b", "a   b", "x \n y", " lead", "tail  ", "\x85 x", "it's  we'll", "<|endoftext|> b", "a<|endoftext|><|endoftext|>  b <|endoftext|>", "<|endoftext|", "a\n\n b"]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_token_counts_equal_plain_dynamic_programming(docs, rows):
    scores = token_counts.piece_scores()
    plain = token_counts.TrieCounter(scores)
    got = Counter((r["doc_id"], r["n_words"], r["n_distinct_words"], r["n_tokens"]) for r in token_counts.token_counts(docs, max_nodes=200).collect())
    want = Counter((r[0], len(words(r[1])), len(set(words(r[1]))), sum(plain.without_trie(token_counts.MARK + w.decode()) for w in words(r[1]))) for r in rows)
    assert got == want


def test_trie_count_is_the_best_split_of_all():
    counter = token_counts.TrieCounter({"▁a": -1.0, "▁": -2.0, "a": -2.0, "b": -2.0, "ab": -2.5, "bab": -3.0, "▁ab": -9.0})

    def best(text):
        if not text:
            return (0.0, 0)
        return max((counter.scores[text[:i]] + best(text[i:])[0], best(text[i:])[1] - 1) for i in range(1, len(text) + 1) if text[:i] in counter.scores)

    for word in ("ab", "abab", "babab", "aab", "bbb"):
        assert counter.count(word) == -best("▁" + word)[1] == counter.without_trie("▁" + word)


def test_licenses_ignore_case_punctuation_and_copyright_lines(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Some Body\n\n" + licenses._MIT.upper().replace(",", " ,")
    table = spark.createDataFrame([(1, mit), (2, "words\nReleased under the MIT Licence!\nmore"), (3, None), (4, ""), (None, "x"), (2, "y"), (5, mit + " and more")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["notices"]) for r in licenses.scanned(table).collect()}
    assert got == {(1, "MIT", None), (2, None, "MIT"), (3, None, None), (4, None, None), (None, None, None), (5, None, None)}


def test_licenses_in_long_and_repeated_rows_under_clashing_columns(spark, docs, rows):
    notice = licenses._ISC + licenses._ISC_NOTICE + licenses._ISC_TAIL
    table = [(1, f"words {notice} words\n" + notice.replace("\n", " "), "x", "y", 0), (2, "word " * 200_000 + "\nLicensed under the MIT licence.", None, "z", 1), (2, "Licensed under the MIT licence.", None, None, 1), (2, "Licensed under the MIT licence.", None, None, 1)]
    found = licenses.scanned(spark.createDataFrame(table, "doc_id long, text string, digest string, license string, line int"))
    assert Counter((r["doc_id"], r["license"], r["notices"]) for r in found.collect()) == Counter([(1, None, "ISC"), (2, None, "MIT"), (2, "MIT", "MIT"), (2, "MIT", "MIT")])
    assert Counter(r["doc_id"] for r in licenses.scanned(docs).collect()) == Counter(r[0] for r in rows)


def test_spellings_side_by_side_and_words_of_notices(spark):
    a, b = (spark.createDataFrame([(text,)], "text string").select(licenses.canonical(F.col("text"))).first()[0] for text in ("Licence licence, Sub-Licence copyright owner", "license LICENSE sublicense copyright holder"))
    assert a == b
    assert all(re.search(licenses.NOTICE_WORDS, text) for _, text in licenses.KNOWN)


def test_licenses_know_creative_commons_and_standard_texts(spark):
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the CC-BY-SA 3.0 licence": "CC-BY-SA-3.0",
        "Released under a Creative Commons Attribution-NoDerivs 2.5 Generic License.": "CC-BY-ND-2.5", "Licensed under CC BY 4.0 and more": None,
    }
    table = spark.createDataFrame([(n, f"words\n{line}\nwords") for n, line in enumerate(lines)], "doc_id long, text string")
    assert {r["doc_id"]: r["notices"] for r in licenses.scanned(table).collect()} == dict(enumerate(lines.values()))
    folder = Path("/usr/share/common-licenses")
    texts = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    here = [(n, (folder / name).read_text().upper()) for n, name in enumerate(texts) if (folder / name).exists()]
    table = spark.createDataFrame(here, "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scanned(table).collect()} == {n: list(texts.values())[n] for n, _ in here}


def test_known_digests_are_in_the_scan_and_in_its_sql(spark, monkeypatch):
    """A made-up text of a known digest, so that nothing depends on what lies on the machine."""
    import duckdb

    body = "The Example Licence\n\nCopyright 2020 Somebody\nYou may do as you like, \"as is\". " * 30
    digest = spark.createDataFrame([(body,)], "text string").select(licenses.digest(F.col("text"))).first()[0]
    monkeypatch.setattr(licenses, "KNOWN_DIGESTS", (*licenses.KNOWN_DIGESTS, ("Example-1.0", digest)))
    rows = [(1, body.upper()), (2, body + "more"), (3, "Licensed under the MIT licence."), (4, None), (5, "")]
    got = {tuple(r) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(r[0], r[2]) for r in got} == {(1, "Example-1.0"), (2, None), (3, "MIT"), (4, None), (5, None)}
    database = duckdb.connect()
    database.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    database.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {tuple(r) for r in database.execute(licenses.oracle_sql()).fetchall()} == got


def test_no_license_line_of_the_tables_stays_unknown(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = docs.selectExpr("doc_id", "explode(split(text, '\\n')) as text").filter("lower(text) rlike 'licen[cs]e'")
    found = licenses.scanned(lines.selectExpr("row_number() over (order by doc_id, text) as doc_id", "text"))
    assert found.count() > 0 and found.filter("license is null").count() == 0


def brute_repeats(w):
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    counts = Counter(windows)
    return len({j for i, x in enumerate(windows) if counts[x] > 1 for j in range(i, i + 3)})


def test_quality_statistics_and_verdicts(docs, rows):
    got = Counter(tuple(r) for r in quality_rules.screened(docs).collect())
    want = Counter()
    for r in rows:
        text, w = r[1] or "", words(r[1])
        lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
        symbols, chars, repeats = sum(text.count(c) for c in "#*$%&|<>"), sum(len(x.decode()) for x in w), brute_repeats(w)
        failed = len(w) < 50 or 2 * repeats > len(w)
        dup = len(lines) - len(set(lines))
        stutter = sum(a == b for a, b in zip(w, w[1:], strict=False))
        kept = not failed and 10 * symbols <= len(w) and 10 * text.count("!") <= 3 * len(w) and 10 * dup <= 4 * len(lines) and 3 * len(w) <= chars <= 10 * len(w) and 5 * stutter <= len(w)
        want[r[0], len(w), chars, symbols, dup, repeats, failed, kept] += 1
    assert got == want


def test_cascade_order_follows_rejections_per_second():
    ticks = iter(range(0, 1000, 1))
    rules = [quality_rules.Rule("none", lambda s: False), quality_rules.Rule("all", lambda s: True), quality_rules.Rule("some", lambda s: s.n_words > 1)]
    assert [r.name for r in quality_rules.cascade([b"a", b"a b"], rules, lambda: next(ticks))][0] == "all"


def test_cascade_counts_shared_statistics_once_and_samples_the_whole_table(spark):
    ticks = iter(range(10_000))

    class Slow(quality_rules.Statistics):
        pass

    def costly(s):  # the words are split by whichever rule comes first
        if "words" not in s.__dict__:
            for _ in range(50):
                next(ticks)
        return s.words

    rules = [quality_rules.Rule("first", lambda s: len(costly(s)) == 1), quality_rules.Rule("after", lambda s: len(costly(s)) == 2), quality_rules.Rule("other", lambda s: not [next(ticks) for _ in range(30)] or len(s.text) == 5)]
    order = quality_rules.cascade([b"a", b"a", b"a", b"a a", b"a a b"], rules, lambda: next(ticks))
    assert [r.name for r in order] == ["first", "after", "other"]
    table = spark.createDataFrame([(i, "BAD" if i >= 500 else "good") for i in range(1000)], "doc_id long, text string").repartition(1)
    only = quality_rules.Rule("bad", lambda s: s.text == b"BAD")
    seen = []
    quality_rules.planned(table, [quality_rules.Rule("see", lambda s: bool(seen.append(s.text)))], sample_rows=100)
    assert len(seen) == 100 and 20 < seen.count(b"BAD") < 80 and quality_rules.planned(table, [only], 10) == [only]


def brute_level(names):
    """Phrases of one level, symbol by symbol, in plain integers."""
    full = 2**64 - 1

    def mix(x):
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & full
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & full
        return x ^ x >> 32

    symbols = []
    for name, group in itertools.groupby(names):
        n = len(list(group))
        symbols.append(name if n == 1 else mix(name + mix(n) & full))
    labels = symbols
    for _ in range(4):
        tossed = []
        for i, label in enumerate(labels):
            other = labels[i - 1] if i else label ^ 1
            bit = ((label ^ other) & -(label ^ other)).bit_length() - 1
            tossed.append(2 * bit + (label >> bit & 1))
        labels = tossed
    phrases = []
    for i, symbol in enumerate(symbols):
        if i == 0 or (labels[i] > labels[i - 1] and (i + 1 == len(symbols) or labels[i] > labels[i + 1])):
            phrases.append([])
        phrases[-1].append(symbol)
    return [mix(sum(mix(s + k * 0x9E3779B97F4A7C15 & full) for k, s in enumerate(p)) & full) for p in phrases], mix


def brute_sketch(text):
    _, mix = brute_level([])
    names, out = [mix(ord(c) + 1) for c in text], []
    for size in (16, 80):
        names, _ = brute_level(names)
        out.append(sorted({n >> 32 for n in names})[:size])
    return out


def brute_likeness(a, b):
    unions = [sorted({*x, *y})[:size] for x, y, size in zip(a, b, (16, 80), strict=True)]
    common = sum(len([h for h in u if h in x and h in y]) for u, x, y in zip(unions, a, b, strict=True))
    return common / sum(map(len, unions)) if any(unions) else 1.0


def test_fingerprints_equal_plain_parsing(rows):
    texts = [r[1] or "" for r in rows] + ["aaaa", "ab" * 50, "a"]
    for text, after in zip(texts, [*texts[1:], texts[0]], strict=True):
        own, nxt = fingerprints.sketches([text, after])
        assert [level.tolist() for level in own] == brute_sketch(text)
        assert fingerprints.likeness(own, nxt) == brute_likeness(brute_sketch(text), brute_sketch(after))


def test_fingerprints_of_texts_edits_and_neighbours(docs, rows):
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in fingerprints.fingerprinted(docs, ranges=4, block_points=3000).collect())
    ordered = sorted(((-(2**63) if r[0] is None else r[0], (r[1] or "").encode(), r[0]) for r in rows))
    want = Counter()
    for i, (_, text, doc_id) in enumerate(ordered):
        text, after = text.decode(), ordered[(i + 1) % len(ordered)][1].decode()
        changed = text[: len(text) - len(text) // 2] + after[: len(text) // 2]
        own, new, nxt = (fingerprints.sketches([t])[0] for t in (text, changed, after))
        want[doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fingerprints.as_string(own), fingerprints.likeness(own, new), fingerprints.likeness(own, nxt)] += 1
    assert got == want


def test_equal_substrings_share_phrases_at_any_offset(rows):
    text = rows[48][1][:4000]
    a, b = fingerprints.sketches([text, "some other beginning " + text])
    assert fingerprints.likeness(a, b) > 0.9
    assert fingerprints.likeness(a, a) == 1 and fingerprints.likeness(a, fingerprints.sketches([""])[0]) == 0
    assert all(np.array_equal(x, y) for x, y in zip(fingerprints.from_string(fingerprints.as_string(a)), a, strict=True))


def test_mixing_meets_its_targets(docs, rows):
    got = mixing.mix(mixing.document_sizes(docs), rows_per_bucket=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert all(abs(taken[s] - targets[s]) <= 1 for s in targets)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate([*sorted(s for s in sizes if s is not None), None])}
    left, free, want = 1.5 * sum(sizes.values()), set(weight), {}
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        capped = {s for s in free if share[s] > 2 * sizes[s]}
        if not capped:
            want |= share
            break
        want |= {s: 2 * sizes[s] for s in capped}
        left -= sum(2 * sizes[s] for s in capped)
        free -= capped
    assert all(abs(targets[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mixed_documents_repeat_and_cut_whole_words(docs, rows):
    plan = mixing.mix(mixing.document_sizes(docs)).collect()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(words(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in plan)


def brute_removed(rows):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - 12):
            if r[0] is not None:
                key = tuple(w[i : i + 13])
                first[key] = min(first.get(key, r[0]), r[0])
    for r in rows:
        w = words(r[1])
        gone = set()
        for i in range(len(w) - 12):
            if r[0] is not None and first[tuple(w[i : i + 13])] < r[0]:
                gone.update(range(i, i + 13))
        yield r[0], w, gone


@pytest.mark.parametrize("block_bytes", [300, 20_000, 1 << 20])
def test_repeated_passages_go(docs, rows, block_bytes):
    got = Counter(tuple(r) for r in substrings.digests(docs, block_bytes=block_bytes, buckets=5).collect())
    want = Counter()
    for doc_id, w, gone in brute_removed(rows):
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want[doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    cut = substrings.deduplicated(docs, block_bytes=block_bytes)
    assert cut.schema == docs.schema
    assert Counter((r["doc_id"], tuple(words(r["text"]))) for r in cut.collect()) == Counter((doc_id, tuple(x for i, x in enumerate(w) if i not in gone)) for doc_id, w, gone in brute_removed(rows))


def by_key(table, key):
    return {k: table.filter(pa.compute.equal(table[key], k)) for k in set(table[key].to_pylist())}


@pytest.mark.parametrize("hashes", [2**64, 3, 1])
def test_words_decide_where_hashes_clash(rows, hashes, monkeypatch):
    """The rounds by hand, with few names for words and windows, so that most windows seem equal."""
    names, joined = substrings._names, substrings._joined
    if hashes < 2**64:
        monkeypatch.setattr(substrings, "_names", lambda index: names(index) % np.uint64(hashes))
        monkeypatch.setattr(substrings, "_joined", lambda a, b: joined(a, b) % np.uint64(hashes))
    texts = [(i, r[1][:1500]) for i, r in enumerate(rows) if r[1]]
    table = pa.table({"text": [t for _, t in texts], "__substrings_id": [i for i, _ in texts], "__substrings_key": [0] * len(texts), "__substrings_block": [i % 4 for i, _ in texts]})
    blocks = by_key(table, "__substrings_block")
    symbols = by_key(pa.concat_tables(substrings._named(t, 3) for t in blocks.values()), "bucket")
    shared = by_key(pa.concat_tables(map(substrings._shared, symbols.values())), "__substrings_block")
    none = pa.table({"symbols": pa.array([], pa.binary())})
    windows = by_key(pa.concat_tables(substrings._compared(t, shared.get(b, none), 3) for b, t in blocks.items()), "bucket")
    spans = {}
    for part in windows.values():
        for r in substrings._verified(part).to_pylist():
            spans.setdefault(r["doc_id"], []).append(r["spans"])
    met = 0
    for doc_id, w, gone in brute_removed(texts):
        assert set(np.nonzero(substrings.removed_words(spans.get(doc_id), len(w)))[0].tolist()) == gone
        met += len(gone)
    assert met > 500


def test_windows_of_equal_hashes_are_told_apart_by_words():
    words = np.array([*range(13), 99, *range(13), 98, *range(1, 14)])
    at = np.array([0, 14, 28])
    assert substrings._classes(at, np.zeros(3, np.uint64), words).tolist()[0] == substrings._classes(at, np.zeros(3, np.uint64), words).tolist()[1]
    assert len(set(substrings._classes(at, np.zeros(3, np.uint64), words).tolist())) == 2


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>one<li>two<ul><li>x</ul><li>three</ul>", "- one\n- two\n  - x\n- three"),
        ("<table><caption>C</caption><tr><th>Name<th>Qty<tr><td>Apple<td>1<tr><td>Fig jam<td>22</table>after", "C\nName     Qty\nApple    1\nFig jam  22\n\nafter"),
        ("<div style='display: none'>no</div><span hidden>no</span>yes<script>if(a<b){'</p>'}</script>!", "yes!"),
        ("<pre>a  b\n  c\n</pre>x", "a  b\n  c\n\nx"),
        ("a<br>b", "a\nb"),
        ("1 < 2 &amp; 3 <!-- c --> d", "1 < 2 & 3 d"),
        ("<ol start=3><li>a<li>b</ol>", "3. a\n4. b"),
        ("<p>unclosed <b>x<p>y</b> z<!-- open", "unclosed x\n\ny z"),
    ],
)
def test_pages_render_as_seen(markup, text):
    assert html_text.page_text(markup) == text


@pytest.mark.parametrize(
    ("markup", "text"),
    [
        ("a <button>Send <b>now</b></button> b", "a Send now b"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"),
        ("<math><semantics><mi>x</mi><annotation>\\x</annotation></semantics></math>", "x"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>label</text></svg> after", "label after"),
        ("a <span aria-hidden='true'>seen</span> b", "a seen b"),
        ("a <select><option>one<option selected>two<option>three</select> b", "a two b"),
        ("a <select><optgroup label=g><option disabled>one<option>two</optgroup></select> b", "a two b"),
        ("<select multiple><option>one<option>two</select>", "one\ntwo"),
    ],
)
def test_pages_show_buttons_selects_formulas_and_drawings(markup, text):
    assert html_text.page_text(markup) == text


def test_deep_pages_and_odd_rows(spark):
    assert html_text.page_text("<div>" * 50_000 + "x") == "x"
    table = spark.createDataFrame([(1, None), (1, "<b>t"), (None, "")], "page_id long, html string")
    assert Counter(tuple(r) for r in html_text.rendered(table).collect()) == Counter([(1, "", 0, 0), (1, "t", 1, 1), (None, "", 0, 0)])


def test_classifier_scores_every_row_and_beats_chance(spark):
    good = [(i, f"the plain words of text {i} go on, and then some more of them stop here. " * 3, int(i % 4 > 0)) for i in range(60)]
    bad = [(100 + i, "BUY!! NOW!! $$$ ### " * (5 + i % 7), 0) for i in range(60)]
    rows = [(i, t) for i, t, _ in [*good, *bad]] + [(None, "x"), (900, None), (900, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in bad] + [(None, 1), (5, None), (5, 1)], "doc_id long, quality int")
    got = classifier.classified(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 200]
    assert sum((r["doc_id"] < 100) == (r["predicted"] == 1) for r in held) >= 0.9 * len(held)
    assert {r["score"] for r in classifier.classified(docs, labels.filter("false")).collect()} == {0.5}


def test_classifier_equals_plain_covariances(spark, docs, rows):
    """The whole model again, class by class, from the features of each text; long texts and clashing columns included."""
    rng = np.random.default_rng(4)
    label_of = {r[0]: int(rng.integers(2)) for r in rows if r[0] is not None}
    labels = spark.createDataFrame(list(label_of.items()), "doc_id long, quality int")
    got = sorted((str(r["doc_id"]), r["score"], r["predicted"]) for r in classifier.classified(docs, labels).collect())
    x = np.array([classifier.features((r[1] or "").encode()) for r in rows])
    train = [i for i, r in enumerate(rows) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5]
    y = np.array([label_of[rows[i][0]] for i in train])
    spread = x[train].std(axis=0)
    z = x / np.where(spread > 1e-9, spread, 1.0)
    densities = []
    for k in (0, 1):
        own = z[train][y == k]
        covariance = np.cov(own.T, bias=True)
        covariance = (1 - classifier.SHRINKAGE) * covariance + classifier.SHRINKAGE * max(np.trace(covariance) / x.shape[1], 1e-3) * np.eye(x.shape[1])
        off = z - own.mean(axis=0)
        densities.append(-0.5 * ((off @ np.linalg.inv(covariance) * off).sum(axis=1) + np.linalg.slogdet(covariance)[1]))
    logit = (np.log((y == 1).sum() / (y == 0).sum()) + densities[1] - densities[0]) / classifier.TEMPERATURE
    want = sorted((str(r[0]), float(s)) for r, s in zip(rows, 1 / (1 + np.exp(-np.clip(logit, -500, 500))), strict=True))
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)
    assert all(predicted == (s >= 0.3) for _, s, predicted in got)


def test_empty_tables_give_empty_results(spark, none):
    runs = [
        simhash.near_duplicates(none), simhash.deduplicated(none), packing.pack(none), token_counts.token_counts(none), licenses.scanned(none), quality_rules.screened(none),
        quality_rules.filtered(none), fingerprints.fingerprinted(none), mixing.mix(mixing.document_sizes(none)), mixing.mixed_documents(none), substrings.digests(none),
        substrings.deduplicated(none), classifier.classified(none, spark.createDataFrame([], "doc_id long, quality int")), html_text.rendered(spark.createDataFrame([], "page_id long, html string")),
    ]
    assert [r.count() for r in runs] == [0] * len(runs)
