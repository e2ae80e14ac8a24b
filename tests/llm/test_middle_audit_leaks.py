"""Fill-in-middle, the filter audit and decontamination against plain versions on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import decontamination, fill_in_middle, filter_audit


def units_of(text, kind):
    pattern = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+", "chars": r"(?s:.)"}[kind]
    return re.findall(pattern, text)


KINDS = {"lines": fill_in_middle.LINES, "words": fill_in_middle.WORDS, "chars": fill_in_middle.CHARS}


@pytest.mark.parametrize("kind", KINDS)
def test_cuts_stand_where_units_end(rows, kind):
    for text in [*(r[1] or "" for r in rows), "\n", "\n\n\na", "a\n\n", " a", "a ", "  ", "é日𝄞ab\r\nñ"]:
        units, runs = units_of(text, kind), fill_in_middle.Runs(text.encode(), KINDS[kind])
        assert len(runs) == len(units)
        places = range(len(units) + 1) if len(units) < 300 else range(0, len(units) + 1, 97)
        for n in places:
            head = "".join(units[:n])
            assert runs.cut(n) == (len(head.encode()), len(head))


def plain_middle(doc_id, text, units="lines", rate=100, spm=50):
    parts = units_of(text, units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i * 8 : i * 8 + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(parts), "plain", None, None, text
    a, b = sorted(x % (len(parts) + 1) for x in h[:2])
    p, m, s = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(parts), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_and_back(spark, docs, rows):
    more = [(1000 + i, t, None, None, 0, None, None, None) for i, t in enumerate(["a<P>b\nc", "<S>", "x<M", "<\n<P\nM>", "a\r\nb\r\n"] + [f"l{i}\nm\nn" for i in range(20)])]
    table = docs.unionAll(spark.createDataFrame(more, docs.schema))
    got = Counter(tuple(r) for r in fill_in_middle.digests(table).collect())
    want = Counter()
    for r in [*rows, *more]:
        text = r[1] or ""
        n, form, prefix, middle, out = plain_middle(r[0], text)
        want[r[0], n, form, prefix, middle, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want
    assert {k[2] for k in got} == {"plain", "psm", "spm"}


def test_transformed_texts_keep_their_rows_and_can_be_restored(docs, rows):
    plan = fill_in_middle.Plan(units=fill_in_middle.CHARS, rate=70, spm=30)
    out = fill_in_middle.transformed(docs, plan, form="passes_form")
    assert out.columns == [*docs.columns, "passes_form"]
    got = out.collect()
    assert Counter((r["doc_id"], r["text"], r["passes_form"], r["n_chars"]) for r in got) == Counter((r[0], (w := plain_middle(r[0], r[1] or "", "chars", 70, 30))[4], w[1], len(w[4])) for r in rows)
    assert {r["passes_form"] for r in got} == {"plain", "psm", "spm"}
    assert Counter((r["doc_id"], fill_in_middle.restored(r["text"].encode(), r["passes_form"]).decode()) for r in got) == Counter((r[0], r[1] or "") for r in rows)


def plain_audit(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good, toxic = ({i for i, *label in labels if label[at] == 1 and i is not None} for at in (0, 1))
    failed = []
    for r in rows:
        text = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {c for c, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search(r"[#$%&*|]", text)), r[0] is not None and r[0] > first[text]), strict=True) if f}
        failed.append((r[3] or "", r[0], fails))
    out, shapley = {}, Counter()
    for order in itertools.permutations("ABCDE"):
        for part, _, fails in failed:
            if fails:
                shapley[part, min(fails, key=order.index)] += 1
    for part in {p for p, _, _ in failed}:
        for order in itertools.permutations("ABCDE"):
            here = [(i, fails) for p, i, fails in failed if p == part]
            for step, c in enumerate(order, 1):
                gone = [i for i, fails in here if c in fails]
                here = [(i, fails) for i, fails in here if c not in fails]
                everyone = [fails for p, _, fails in failed if p == part]
                out[part, "".join(order), step] = (
                    len(here), len(gone), sum(c in f for f in everyone) - len(gone), sum(f == {c} for f in everyone),
                    sum(i in good for i in gone), sum(i in toxic for i in gone), shapley[part, c],
                )
    return out


def test_audit_of_all_orders(spark, docs, rows):
    rng = random.Random(4)
    more = [(500 + i, rows[i % 30][1] if i % 3 else "A# " * 60, "en", "src1" if i % 2 else None, 0, None, None, None) for i in range(40)]
    more += [(None, "A# " * 60, None, None, 0, None, None, None)] * 2 + [(501, more[1][1], None, "src1", 0, None, None, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, 150, 2), *range(500, 540)]] + [(None, 1, 1), (6, 1, 0), (6, 0, 1), (9999, 1, 1)]
    table = docs.unionAll(spark.createDataFrame(more, docs.schema))
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    want = plain_audit([*rows, *more], labels)
    assert got == want
    assert any(x[4] for x in want.values()) and any(x[5] for x in want.values()) and len({k[1] for k in got}) == math.factorial(5)


def test_audit_of_other_filters_and_parts(spark, docs):
    filters = (filter_audit.Filter("x", lambda text, words: text.contains("a")), filter_audit.Filter("y", lambda text, words: text == ""))
    got = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), filters, copies="z", part="lang").collect()
    assert Counter(r["part"] for r in got) == {"en": 18, "": 18}
    n = docs.filter("lang is null").count()
    assert all(r["kept"] + r["removed"] <= n for r in got if r["part"] == "")


def plain_leaks(rows, benchmark, window=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = defaultdict(set)
    for item, text in benchmark:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[i : i + window])].add("" if item is None else str(item))
    for r in rows:
        w, hit, items = words(r[1]), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    items |= found
        yield r[0], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)


def leak_fixture(rows):
    """Items taken from documents in other case and punctuation, short ones, repeated ones, and ones that repeat themselves."""
    rng = random.Random(11)
    texts = [re.findall(r"[a-z]+", r[1]) for r in rows[:40]]
    items = [(i, "; ".join(t[5 : 5 + rng.choice([9, 10, 11, 30])]).upper()) for i, t in enumerate(texts[:20])]
    items += [(3, " ".join(texts[30][:12])), (50, " ".join(texts[30][:12])), (51, "ab cd " * 8), (52, "two words"), (53, "spam " * 12), (54, "Of"), (55, None), (56, "... !"), (None, " ".join(texts[31][3:20])), (57, "É日 ü no such words at all"), (58, " ".join(texts[32] + ["unseen"] + texts[33]))]
    return items


@pytest.mark.parametrize("options", [{}, {"shard_words": 150}, {"shard_words": 1}, {"slice_bytes": 400, "piece_words": 3, "shard_words": 1000}])
def test_leaked_words_and_items(spark, docs, rows, options):
    items = leak_fixture(rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontamination.digests(docs, benchmark, **options).collect()) == Counter(plain_leaks(rows, items))
    clean = decontamination.decontaminated(docs, benchmark, **options)
    assert clean.schema == docs.schema
    assert Counter(r["passes"] for r in clean.collect()) == Counter(r[7] for r, leak in zip(rows, plain_leaks(rows, items), strict=True) if not leak[-1])


def test_longest_matches_of_every_test_suffix(spark, docs, rows):
    items = [x for x in leak_fixture(rows) if x[0] is not None and x[1] and x[0] not in (3, 50)]
    got = {(r["item"], r["item_word"]): tuple(r)[2:] for r in decontamination.longest_matches(docs, spark.createDataFrame(items, "item_id long, text string"), least=2, shard_words=300).collect()}
    texts = [(r[0], re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (r[1] or "").lower())) for r in rows]
    want = {}
    for item, text in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        for j in range(len(w)):
            best, places = 0, []
            for doc_id, t in texts:
                for p in range(len(t)):
                    n = 0
                    while n < len(w) - j and p + n < len(t) and t[p + n] == w[j + n]:
                        n += 1
                    if n > best:
                        best, places = n, []
                    if n == best:
                        places.append((doc_id is None, doc_id or 0, p))
            if best >= 2:
                _, doc_id, p = min(places)
                want[str(item), j] = (best, len(places), None if min(places)[0] else doc_id, p)
    assert got == want


@pytest.mark.parametrize("reach", [1, 3, 40])
def test_suffix_array_is_sorted_as_far_as_it_reaches(reach):
    rng = np.random.default_rng(reach)
    for top in (2, 5, 1 << 20):
        ids = np.append(rng.integers(0, top, 400), 0).astype(np.int32)
        places = decontamination.suffix_array(ids, reach)
        assert sorted(places.tolist()) == np.flatnonzero(ids).tolist()
        suffixes = [tuple(itertools.takewhile(bool, ids[p : p + reach].tolist())) for p in places]
        assert suffixes == sorted(suffixes)


def test_empty_tables(spark, none):
    some = spark.createDataFrame([(1, "some words")], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    runs = [fill_in_middle.digests(none), fill_in_middle.transformed(none), filter_audit.audit(none, labels), decontamination.digests(none, some), decontamination.decontaminated(none, some), decontamination.longest_matches(none, some)]
    assert [r.count() for r in runs] == [0] * len(runs)


def test_nothing_leaks_from_an_empty_benchmark(spark, docs, rows):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.decontaminated(docs, empty).count() == len(rows)
    assert decontamination.digests(docs, empty).filter("contaminated or n_items > 0").count() == 0
    assert decontamination.longest_matches(docs, empty).count() == 0
