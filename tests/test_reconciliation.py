"""Findings on small ledgers with known outcomes."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom import catalog
from ledgerloom.functions import amounts, identifiers
from ledgerloom.operators import duplicates, explain, invoices, ledgers, matching, renames, report, row_rules, screening, vendors

SCHEMA = "row_index long, gstin string, identifier string, trade_legal_name string, particulars string, place_of_supply string, reverse_charge string, rate long, taxable_value long, igst long, cgst long, sgst long, invoice_date date"
G = "07AAAPL0001Q1Z5"
DAY = dt.date(2024, 4, 1)


def row(index, number, tv=100_000, igst=18_000, day=0, gstin=G, cgst=0, sgst=0, place="27-X", text=None, flag=None, rate=18):
    return (index, gstin, number, "Name", text, place, flag, rate, tv, igst, cgst, sgst, DAY + dt.timedelta(days=day))


@pytest.fixture(scope="module")
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), SCHEMA)


def one(spark, expression, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("cell", "number"), [("1,234.50", 1234.5), ("(1,234)", 1234.0), ("12abc", 12.0), ("₹", None), ("", None), ("18%", 18.0), ("-2.5", -2.5)])
def test_numbers_from_text(spark, cell, number):
    assert one(spark, amounts.number_or_null(F.col("c")), c=cell) == number


@pytest.mark.parametrize(("cell", "day"), [("2024-04-05", dt.date(2024, 4, 5)), ("5-4-2024", dt.date(2024, 4, 5)), ("05/04/2024", dt.date(2024, 4, 5)), ("46200", dt.date(2026, 6, 27)), ("31-13-2021", None), ("x", None)])
def test_dates_from_text(spark, cell, day):
    assert one(spark, amounts.date_or_null(F.col("c")), c=cell) == day


def test_rounding_and_grouping(spark):
    assert one(spark, amounts.round_half_up(F.col("c")), c=-2.005) == -2.0
    assert one(spark, amounts.indian_grouping(F.col("c")), c=2_318_036_187) == "2,31,80,362"


@pytest.mark.parametrize(("a", "b", "same"), [("BLY/21-22/280", "BLY-2021-22-280", True), ("STPL//1181", "STPL/1181", True), ("A/7081", "A/8071", False), ("X/21-22/10", "X/20-21/10", True), ("21-22", "20-21", False), ("AB/12", "AB/123", True)])
def test_invoice_numbers_that_may_be_one(spark, a, b, same):
    x, y = F.col("a"), F.col("b")
    agree = identifiers.numbers_agree(x, y, identifiers.core_segments(x), identifiers.core_segments(y), identifiers.normalized_number(x), identifiers.normalized_number(y))
    assert one(spark, agree, a=a, b=b) is same


def test_places_and_states(spark):
    for place, code in (("27-Maharashtra", "27"), ("Andhra Pradesh", "37"), ("Orissa", "21"), ("25-Nowhere", None), (" Delhi ", "07")):
        assert one(spark, identifiers.state_of_place(F.col("p")), p=place) == code


def test_vendor_status_looks_at_tax_heads(table):
    a = table(row(1, "A"), row(2, "B", gstin="B" * 15, igst=10_000), row(3, "C", gstin="C" * 15))
    b = table(row(1, "A", tv=999_999, igst=18_099), row(2, "B", gstin="B" * 15, igst=19_000), row(4, "D", gstin="D" * 15), row(5, "E", gstin="  "))
    got = {r["gstin"][0]: r["status"] for r in vendors.compare(a, b).collect()}
    assert got == {"0": "matched", "B": "discrepancy", "C": "missing_in_books", "D": "missing_in_gstr2a"}


def test_matching_tiers(table):
    a = table(row(1, "INV/1"), row(2, "GSTINV/163"), row(3, "7", tv=5_000), row(4, "BLY/21-22/280", tv=70_000), row(5, "Z9", tv=80_000, day=2), row(6, "AMB"), row(7, "AMB", tv=1), row(8, "LONE", tv=42, igst=7))
    b = table(row(1, "inv/1 "), row(2, "163", tv=3), row(3, "007", tv=5_050, day=2), row(4, "BLY-2021-22-280", tv=70_000), row(5, "", tv=80_000, day=9), row(6, "AMB"), row(9, "OTHER", tv=7_700, igst=900))
    e = invoices.detect_extras(a, b)
    pairs = lambda df: {(r["l_row_index"], r["r_row_index"]) for r in df.collect()}
    assert pairs(e.short_numbers) == {(3, 3)}
    assert pairs(e.normalized_numbers) == {(4, 4)}
    assert pairs(e.possible_matches) == {(5, 5)}
    assert {r["row_index"] for r in e.extra_in_2a.collect()} == {7, 8}
    assert {r["row_index"] for r in e.extra_in_books.collect()} == {9}


def test_heads_rates_and_keywords(table):
    rows = table(
        row(1, "A", place="07-Delhi"), row(2, "B", igst=18_000, cgst=9_000), row(3, "C", place=None), row(4, "D", igst=10_000),
        row(5, "E", text="Lorry freight", flag="n"), row(6, "F", text="Lorry freight"), row(7, "G", text="metal scrap"), row(8, "H", text="Metal scrap", gstin=""), row(9, "I", text="Staff canteen", flag=" Yes "),
    )
    assert {(r["row_index"], r["issue"]) for r in row_rules.wrong_head(rows).collect()} == {(1, "wrong_head"), (2, "mixed_tax_heads")}
    assert {r["row_index"]: r["difference"] for r in row_rules.rate_mismatch(rows).collect()} == {2: 9_000, 4: -8_000}
    assert {(r["row_index"], r["found_by"], r["category"]) for r in row_rules.reverse_charge(rows).collect()} == {(6, "keyword_match", "gta_freight"), (8, "keyword_match", "metal_scrap"), (9, "reverse_charge_flag", None)}
    assert [(r["row_index"], r["category"], r["keyword"]) for r in row_rules.blocked_credit(rows).collect()] == [(9, "food_beverage", "canteen")]


def test_names_are_not_descriptions(table):
    rows = [row(i, "A", gstin=f"{i // 2:015d}", text=f"Vendor {i // 2}") for i in range(8)]
    assert not row_rules.describe(table(*rows)).usable
    assert row_rules.describe(table(*[(*r[:4], f"{r[4]} {r[0]}", *r[5:]) for r in rows])).usable


def brute_clusters(rows):
    """Every pair in row order, under the rules as they are stated."""
    parent = {r["i"]: r["i"] for r in rows}
    span = {r["i"]: (r["d"], r["d"], r["tv"], r["tv"]) for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            x, y = rows[a], rows[b]
            close, days = abs(x["tv"] - y["tv"]) <= 100, abs((x["d"] - y["d"]).days)
            i, j = find(x["i"]), find(y["i"])
            if not close or i == j:
                continue
            merged = (min(span[i][0], span[j][0]), max(span[i][1], span[j][1]), min(span[i][2], span[j][2]), max(span[i][3], span[j][3]))
            if x["n"] == y["n"]:
                if days > 45:
                    continue
            elif days > 3 or sum(abs(z["tv"] - x["tv"]) <= 100 for z in rows) > 2 or (merged[1] - merged[0]).days > 3 or merged[3] - merged[2] > 100:
                continue
            parent[max(i, j)] = min(i, j)
            span[min(i, j)] = merged
    groups = {}
    for r in rows:
        groups.setdefault(find(r["i"]), set()).add(r["i"])
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def test_duplicate_clusters_equal_all_pairs(table):
    rng = random.Random(5)
    rows, want = [], set()
    for vendor in range(12):
        group = [{"i": 100 * vendor + k, "n": rng.choice(["A-X", "B-Y", "C-Z", "D-W"]), "tv": 1000 * rng.randint(1, 6) + rng.choice([0, 60, 120]), "d": DAY + dt.timedelta(days=rng.randint(0, 60))} for k in range(14)]
        want |= brute_clusters(group)
        rows += [(r["i"], f"{vendor:015d}", r["n"], "N", None, None, None, 0, r["tv"], 0, 0, 0, r["d"]) for r in group]
    found = {}
    for r in duplicates.clusters(table(*rows)).collect():
        found.setdefault(r["cluster"], set()).add(r["row_index"])
    assert {frozenset(g) for g in found.values()} == want


def joining(pairs):
    """The pairs that join two sets, taken in order."""
    parent, out = {}, []

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in sorted(pairs):
        if find(a) != find(b):
            parent[find(b)] = find(a)
            out.append((a, b))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_links_of_numbers_join_what_all_pairs_join(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice("VW"), rng.choice(["N1", "N2"]), rng.choice([None, 1000, 1060, 1120, 1180, 5000]), rng.choice([None, 18.0, 18.4, 18.8, 5.0]), DAY + dt.timedelta(days=rng.randrange(0, 160, (4, 8, 40)[seed]))) for i in rng.sample(range(1000), 220)]
    records = spark.createDataFrame(rows, "row_index long, gstin string, identifier string, amount long, rate double, date date")
    pairs, links = ({(r["a"], r["b"]) for r in f(records).collect()} for f in (duplicates.number_pairs, duplicates.number_links))
    assert links <= pairs and joining(links) == joining(pairs)


def test_a_number_entered_all_the_time_gives_about_one_link_a_row(spark):
    n = 20_000
    days = spark.range(n).selectExpr("id as row_index", "'V' as gstin", "'N' as identifier", "100000L as amount", "18D as rate", "date_add(date'2024-04-01', cast(id % 45 as int)) as date")
    assert duplicates.number_links(days).count() <= n + 45 * 44 / 2


def test_numbers_in_sequence_are_not_duplicates(table):
    rows = table(row(1, "ST/23", tv=500), row(2, "ST/24", tv=500, day=1), row(3, "Q/1", tv=900), row(4, "R/9", tv=900, day=1))
    assert {(r["a"], r["b"]) for r in duplicates.amount_pairs(duplicates.records(rows)).collect()} == {(3, 4)}


def test_summary_nets_blocked_credit_and_confirmed_duplicates(table):
    a = table(row(1, "A"), row(2, "B", tv=50_000, igst=9_000))
    b = table(row(1, "A"), row(2, "B", tv=50_000, igst=9_000, text="catering"), row(3, "A", day=20))
    p = report.propose(a, b, True)
    s = report.summary(p).first()
    assert (s["supportable"], s["blocked_amount"], s["duplicate_amount"], s["net_eligible"]) == (27_000, 9_000, 18_000, 0)
    issues = report.ranked(report.top_issues(p)).collect()
    assert issues[0]["tier"] == 1 and issues[0]["category"] == "Ineligible ITC"


def test_reports_are_written_on_acceptance_and_keep_notes(spark, table, tmp_path):
    p = report.propose(table(row(1, "A")), table(row(2, "B", tv=5)), True)
    places = report.accept(p, str(tmp_path / "out"))
    assert len(places) == 10 and spark.read.parquet(places["extra_in_2a"]).count() == 1
    notes = spark.createDataFrame([(G, "A", 9, "Resolved elsewhere", "seen"), (G, "gone", 9, "", "x")], "gstin string, identifier string, row_index long, reviewer_status string, reviewer_note string")
    kept = report.carry_notes(p.extras.extra_in_2a, notes, ["gstin", "identifier"]).first()
    assert kept["reviewer_note"] == "seen"
    assert [r["identifier"] for r in report.orphaned_notes(p.extras.extra_in_2a, notes, ["gstin", "identifier"]).collect()] == ["gone"]


def test_notes_outlive_the_next_report_and_rows_are_explained(spark, table, tmp_path):
    place = str(tmp_path / "out")
    report.accept(report.propose(table(row(1, "A")), table(row(2, "B", tv=5)), True), place)
    first = spark.read.parquet(f"{place}/extra_in_2a")
    assert first.first()["rule"] == "Extra in 2A" and first.first()["reviewer_note"] is None
    written = [{**r.asDict(), "reviewer_status": "Needs follow-up", "reviewer_note": "asked"} for r in first.collect()]
    spark.createDataFrame(written, first.schema).write.mode("overwrite").parquet(f"{place}/extra_in_2a")
    report.accept(report.propose(table(row(1, "C"), row(9, "A")), table(row(2, "B", tv=5)), True), place)
    again = {r["identifier"]: r["reviewer_note"] for r in spark.read.parquet(f"{place}/extra_in_2a").collect()}
    assert again == {"C": None, "A": "asked"}


def test_one_sheet_rules_run_on_both_sheets(table):
    twice = [row(1, "A", text="canteen"), row(2, "A"), row(3, "B", tv=70_000), row(4, "B", tv=70_000)]
    p = report.propose(table(*twice), table(*twice[:2], row(7, "Z", tv=9)), True, True)
    assert sorted((r["source"], r["row_index"]) for r in p.blocked.collect()) == [("books", 1), ("gstr2a", 1)]
    numbers = {(r["source"], r["cluster"], r["number"]) for r in p.duplicates.collect()}
    assert numbers == {("gstr2a", 1, 1), ("gstr2a", 3, 2), ("books", 1, 1)}
    summary = report.summary(p).first()
    assert summary["duplicate_rows"] == 1 and summary["blocked_rows"] == 2


def test_limits_of_duplicates_can_be_set(table):
    far = table(row(1, "A", day=1), row(2, "A", day=25))
    assert duplicates.clusters(far).count() == 2
    assert duplicates.clusters(far, duplicates.Limits(identifier_days=10)).count() == 0


QUICK = (
    "vendor_status_counts", "invoice_exact_match", "fuzzy_digit_bridge", "wrong_head", "cross_wrong_head", "rate_mismatch", "dup_identifier_edges",
    "vendor_renames", "vendor_names_from_text", "platform_drift", "delivery_revenue", "short_id_tiebreak", "commission_drift", "pnl_monthly", "similar_vendors",
)


@pytest.mark.parametrize("name", QUICK)
def test_queries_equal_their_sql(spark, name):
    folder = Path("/root/testdata/sf0.001")
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = catalog.QUERIES[name](spark, str(folder))
    wanted = con.execute(f"SELECT {', '.join(sorted(found.columns))} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    plain = lambda rows: Counter(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert wanted and plain(found.select(*sorted(found.columns)).collect()) == plain(wanted)


def test_explained_wrong_heads_equal_their_sql(spark):
    test_queries_equal_their_sql(spark, "wrong_head_explained")


def test_side_at_fault_stands_in_the_ground(table):
    heads = table(row(1, "A", place="07-X"), row(2, "B", place=""))
    both = row_rules.cross_wrong_head(heads, table(*(row(i, n, igst=0, cgst=9_000, sgst=9_000) for i, n in ((3, "A"), (4, "B")))))
    rows = row_rules.wrong_head(heads).withColumn("section", F.lit("statement")).unionByName(both.withColumn("section", F.lit("both sides")), allowMissingColumns=True)
    found = {(r["section"], r["identifier"]): r for r in explain.explained("wrong_head", rows).collect()}
    assert {key: r["finding"].split("; ")[-1] for key, r in found.items() if key[0] == "both sides"} == {("both sides", "A"): "expected CGST+SGST", ("both sides", "B"): "expected unknown"}
    assert {key: r["ground"].split("; ")[1:] for key, r in found.items()} == {("statement", "A"): [], ("both sides", "A"): ["at fault by these: statement"], ("both sides", "B"): ["at fault by these: not determined"]}


def test_ledger_statuses(spark):
    schema = "row_index long, invoice_no string, supplier string, amount long, date string"
    ledger = spark.createDataFrame([(0, "1", "Acme Ltd", 100, "a"), (1, "1", "Acme Ltd", 100, "a"), (2, "2", "Acme Ltd", 120, "a"), (3, "3", "Acme Ltd", 100, "b"), (4, "4", "Acme Lts", 7, "a"), (5, "5", "Zzz", 7, "a"), (6, "6", "Acme Ltd", 55, "a"), (7, "7", "Other", 10, "a")], schema)
    statement = spark.createDataFrame([(0, "1", "Acme Ltd", 100, "a"), (1, "2", "Acme Ltd", 96, "a"), (2, "3", "Acme Ltd", 100, "c"), (3, "6", "Acme Ltd", 50, "a"), (4, "7", "Acme Ltd", 10, "a"), (5, "8", "Acme Ltd", 1, "a")], schema)
    got = {(r["side"][0], r["row_index"]): r["status"] for r in ledgers.compare_ledger(ledger, statement).collect()}
    assert got == {("l", 0): "MATCHED", ("l", 1): "DUPLICATE", ("l", 2): "VAT_ISSUE", ("l", 3): "DATE_DIFF", ("l", 4): "FUZZY_VENDOR", ("l", 5): "MISSING_SUPPLIER", ("l", 6): "AMOUNT_DIFF", ("l", 7): "FUZZY_VENDOR", ("s", 5): "MISSING_LEDGER"}


def test_names_join_the_first_leader_that_is_alike(spark):
    names = spark.createDataFrame([("Acme Limited", 1), ("Acme Ltd", 2), ("acme limited", 3), ("Other", 4), ("Acme Limited", 5), (" ", 6)], "vendor string, row_index long")
    assert {(r["alias"], r["canonical"]) for r in renames.vendor_renames(names).collect()} == {("Acme Limited", "Acme Limited"), ("Acme Ltd", "Acme Limited"), ("acme limited", "acme limited"), ("Other", "Other")}


def test_commission_moves_and_months_add_up(spark):
    gross = spark.createDataFrame([("p", "2024-01", 100), ("p", "2024-02", 100), ("p", "2024-03", 100)], "platform string, month string, amount long")
    net = spark.createDataFrame([("p", "2024-01", 70), ("p", "2024-02", 70), ("p", "2024-03", 60)], "platform string, month string, amount long")
    assert [r["month"] for r in ledgers.commission_drift(gross, net).collect()] == ["2024-03"]
    months = spark.createDataFrame([("2024-01", 100, 40, 10), ("2024-02", 90, None, 10)], "month string, sales long, food long, rent long")
    got = [tuple(r)[-3:] for r in ledgers.profit_and_loss(months, ["sales"], ["food"], ["rent"]).orderBy("month").collect()]
    assert got == [(60, 50, None), (90, 80, 30)]


def test_platforms_are_told_by_column_and_description(spark):
    sales = spark.createDataFrame([("May 2026", 100, 50, 0), ("Jun 2026", 200, None, 10), ("soon", 1, 1, 1)], "month string, deliveroo long, ubereats long, justeat long")
    bank = spark.createDataFrame([("2026-05-31", "Deliveroo payout", "Delivery Platform Payout", 72), ("2026-06-30", "Deliveroo", "Delivery Platform Payout", 140), ("2026-06-30", "Deliveroo", "Other", 9), ("2026-06-30", "My Deliveroo", "Delivery Platform Payout", 9), (None, "JustEat", "Delivery Platform Payout", 9)], "date string, description string, category string, amount long").withColumn("date", F.col("date").cast("date"))
    gross, net = ledgers.platform_sales(sales), ledgers.platform_payouts(bank)
    assert [tuple(r) for r in net.orderBy("month").collect()] == [("deliveroo", "2026-05", 72), ("deliveroo", "2026-06", 140)]
    assert [(r["platform"], r["month"], round(r["previous"], 6), round(r["rate"], 6)) for r in ledgers.commission_drift(gross, net).collect()] == [("deliveroo", "2026-06", 0.28, 0.3)]
    rates = spark.createDataFrame([("deliveroo", "2026-05", 0.25), ("ubereats", "2026-05", 0.5)], "platform string, month string, rate double")
    assert [tuple(r) for r in ledgers.net_of_commission(gross, rates).collect()] == [("2026-05", 100.0)]
    spent = ledgers.conditional_sums(bank.filter("date is not null"), F.date_format("date", "yyyy-MM"), {"other": ledgers.spent_on("Other")})
    assert {tuple(r) for r in spent.collect()} == {("2026-05", 0), ("2026-06", -9)}


def test_audit_log_grows(spark, tmp_path):
    rows = spark.createDataFrame([("now", "A1", "written")], "time string, place string, text string")
    for _ in range(2):
        report.append_audit(rows, str(tmp_path / "audit"))
    assert report.audit_count(spark, str(tmp_path / "audit")) == 2 and report.audit_count(spark, str(tmp_path / "none")) == 0


def test_similar_names_equal_all_pairs(spark):
    rng = random.Random(5)
    names = ["", " ", None, "a", "A", "ab", "é" * 40, "Acme Ltd", "ACME LTD ", "Acme Ltd."] + ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    left, right = spark.createDataFrame([(n,) for n in names[:45]], "x string"), spark.createDataFrame([(n,) for n in names[25:] + names[:9]], "y string")
    for least in (60, 80, 95):
        measured = left.distinct().crossJoin(right.distinct()).withColumn("s", identifiers.similarity_percent(F.col("x"), F.col("y"))).filter("trim(x) <> '' and trim(y) <> ''")
        want = {tuple(r) for r in measured.filter(F.col("s") >= least).collect()}
        rows = matching.similar_names(left, right, least).collect()
        assert {tuple(r) for r in rows} == want and len(rows) == len(want) and want


def test_sets_of_pairs_that_span_batches(spark):
    pairs = pd.DataFrame([(c, c * 100 + i, c * 100 + i + 1) for c in range(1, 6) for i in range(7)], columns=["component", "a", "b"])
    pairs = pairs.assign(gstin="g" + pairs["component"].astype(str), by_number=True, a_day=0, b_day=0, a_amount=1, b_amount=1)
    whole = duplicates._greedy(pairs).sort_values("row_index").values.tolist()
    for size in (1, 3, 7, 10, 100):
        parts = [pairs.iloc[i : i + size] for i in range(0, len(pairs), size)]
        got = pd.concat(duplicates._streamed(iter([*parts[:1], pairs.iloc[:0], *parts[1:]])))
        assert got.sort_values("row_index").values.tolist() == whole
    assert len(whole) == 40 and list(duplicates._streamed(iter([]))) == []


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i, *[0] * len(b)], row
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return row[-1]


def plain_renames(given):
    leaders, found = [], set()
    for name in given:
        a = name.strip().lower()
        share = lambda b: int((1 - plain_distance(b, a) / max(len(a), len(b))) * 100 + 0.5)  # noqa: B023, E731
        leader = next((x for x in leaders if 55 <= share(x.strip().lower()) < 100), name)
        leaders += [name] if leader == name else []
        found.add((leader, name))
    return found


def test_renames_meet_across_first_letters(spark):
    given = ["Fresh Fields Ltd", "The Fresh Fields Ltd", "Acme Foods", "4cme Foods", "Fresh Field Ltd", "Zebra", "fresh fields ltd", "Xcme Foodz", "q"]
    names = spark.createDataFrame(list(enumerate(given)), "row_index long, vendor string")
    expected = plain_renames(given)
    assert {("Fresh Fields Ltd", "The Fresh Fields Ltd"), ("Acme Foods", "4cme Foods")} <= expected
    assert {(r["canonical"], r["alias"]) for r in renames.vendor_renames(names).collect()} == expected


@pytest.mark.parametrize("per_round", [1, 7, 40, 4096])
def test_renames_elected_in_rounds_equal_one_pass(spark, per_round):
    rng = random.Random(per_round)
    words = ["Fresh", "Fields", "Müller", "& Co", "Trading", "Ltd", "GmbH", "日本", "Zen", "Apex", "x"]
    given = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(50 if per_round < 7 else 250)]
    given += [g[: rng.randint(1, 9)] + rng.choice("abc ") + g[3:] for g in given[:80]] + ["y" * 70 + g for g in given[:6]] + [" Zen  ", "ZEN", "\U0001d11e" * 3, "a", "b"]
    given = list(dict.fromkeys(g for g in given if g.strip()))
    rows = [(i, g) for i, g in enumerate(given)] + [(5000, given[3]), (5001, None), (5002, "  ")]
    names = spark.createDataFrame(rows, "row_index long, vendor string").repartition(3)
    assert {(r["canonical"], r["alias"]) for r in renames.vendor_renames(names, per_round).collect()} == plain_renames(given)
    assert renames.vendor_renames(names.limit(0)).isEmpty()


def test_distances_of_many_pairs_at_once():
    rng = random.Random(2)
    a, b = (["".join(rng.choices("abcé日", k=rng.choice([0, 1, 5, 20, 63, 64, 65, 90]))) for _ in range(60)] for _ in range(2))
    leaders, names = renames.Leaders(a), renames.Names(b)
    one, other = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    assert renames.distances(leaders, names, one, other).tolist() == [plain_distance(a[i], b[j]) for i, j in zip(one.tolist(), other.tolist(), strict=True)]


def test_elections_do_not_depend_on_how_many_names_go_at_once():
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcd", k=rng.randint(3, 9))) for _ in range(200)]
    assert renames.elected(texts, 1) == renames.elected(texts, 7) == renames.elected(texts, 500)


@pytest.mark.parametrize("few", [0, 12, 1000])
def test_numbers_that_may_be_one_meet_without_all_pairs(spark, table, few):
    rng = random.Random(8)
    forms = ["INV/{}/21-22", "INV-{}-2021-22", "{}", "A/{}", "A/B/{}/2021-22", "inv-0{}", "21-22", "A//{}", "{}/24"]
    sides = [[row(i, rng.choice(forms).format(rng.choice([7, 71, 712, 8, 9])), tv=rng.choice([1000, 1050, 1120, 9000])) for i in range(70)] for _ in range(2)]
    a, b = (invoices.indexable(invoices.canonical(table(*rows))) for rows in sides)
    got = {(r["l_row_index"], r["r_row_index"]) for r in invoices._pairs_by_normalized_number(a, b, few).collect()}
    x, y = a.select("row_index", "identifier", "taxable_value").toDF("i", "x", "tv"), b.select("row_index", "identifier", "taxable_value").toDF("j", "y", "tw")
    alike = identifiers.numbers_agree(F.col("x"), F.col("y"), *(f(F.col(c)) for f in (identifiers.core_segments, identifiers.normalized_number) for c in "xy"))
    want = {(r["i"], r["j"]) for r in x.crossJoin(y).filter(alike & (F.abs(F.col("tv") - F.col("tw")) <= 100)).collect()}
    assert got == want and len(want) > 100
    flat = [table(*(row(i, f"INV/{n}/{10000 + i}/21-22") for i in range(400))) for n in (1, 2)]
    keyed = [invoices._number_keys(invoices.canonical(t), cut).filter("whole") for t, cut in zip(flat, (True, False), strict=True)]
    assert keyed[0].join(keyed[1], ["gstin", "number_key"]).isEmpty()  # one vendor, one amount, and no pair is tried


def test_runs_that_many_numbers_hold_bridge_nothing(table):
    a = table(*(row(i, f"X/{i + 500}/2021") for i in range(50)), row(60, "777"), row(61, "900"))
    b = table(*(row(i, f"Y/{i + 600}/2021") for i in range(50)), row(60, "Z-777"), row(61, "P/900"), row(62, "Q/900"), row(63, "505"))
    found = {(r["identifier"], r["other_identifier"]) for r in invoices.digit_bridges(invoices.canonical(a), invoices.canonical(b)).collect()}
    assert found == {("777", "Z-777"), ("X/505/2021", "505")}


def test_first_entries_of_blank_numbers(spark):
    schema = "row_index long, invoice_no string, supplier string, amount long, date date"
    ledger = spark.createDataFrame([(5, "", "A", 1, DAY), (3, "", "A", 2, DAY), (4, None, "A", 3, DAY), (7, None, "B", 4, DAY), (8, "N", "a", 2, DAY), (9, "N1", "C", 9, DAY)], schema)
    statement = spark.createDataFrame([(2, "", "A", 2, DAY), (1, "", "Zzzz", 2, DAY), (3, "N1", "C", 9, DAY)], schema)
    got = {(r["side"], r["row_index"]): r["status"] for r in ledgers.compare_ledger(ledger, statement).collect()}
    assert got == {("ledger", 3): "FUZZY_VENDOR", ("ledger", 5): "DUPLICATE", ("ledger", 4): "MISSING_SUPPLIER", ("ledger", 7): "DUPLICATE", ("ledger", 8): "DUPLICATE", ("ledger", 9): "MATCHED", ("statement", 2): "MISSING_LEDGER"}


def test_notes_of_rows_that_are_gone_are_kept_counted_and_come_back(spark, table, tmp_path, monkeypatch):
    place = str(tmp_path / "out")

    def run(*numbers):
        monkeypatch.setattr(report, "tables", lambda p, suggestions: {"extra_in_2a": table(*(row(i, n) for i, n in enumerate(numbers)))})
        report.accept(None, place)
        return {(r["identifier"], r["reviewer_note"]) for r in spark.read.parquet(f"{place}/extra_in_2a").collect()}

    run("A", "C", "C")
    rows = [{**r.asDict(), "reviewer_note": f"{r['identifier']}{r['row_index']}"} for r in spark.read.parquet(f"{place}/extra_in_2a").collect()]
    spark.createDataFrame(rows, spark.read.parquet(f"{place}/extra_in_2a").schema).write.mode("overwrite").parquet(f"{place}/extra_in_2a")
    assert run("C", "D") == {("C", "C1"), ("D", None)}
    assert {(r["report_table"], r["row_key"], r["reviewer_note"]) for r in report.orphans(spark, place).collect()} == {("extra_in_2a", f"{G}|A", "A0"), ("extra_in_2a", f"{G}|C", "C2")}
    assert [tuple(r) for r in report.note_counts(spark, place).collect()] == [("extra_in_2a", 1, 2)]
    run("D")
    assert report.orphans(spark, place).count() == 3
    assert run("A", "C", "C") == {("A", "A0"), ("C", "C1"), ("C", "C2")} and report.orphans(spark, place).isEmpty()


def test_issues_show_their_tax_by_head(spark, table):
    p = report.propose(table(row(1, "A", igst=0, cgst=9_050, sgst=9_000, place="07-Delhi"), row(2, "C")), table(row(2, "B", tv=5)), True)
    found = {(r["category"], r["row_index"]): r["breakdown"] for r in report.top_issues(p).collect()}
    assert found["Extra in 2A", 1] == "CGST 90.50 + SGST 90.00" and found["Extra in 2A", 2] is None
    assert one(spark, amounts.day_text(F.col("d")), d=DAY) == "2024-04-01"


def test_suggestions_of_vendors_are_a_report_table(spark, table, tmp_path):
    clean = report.propose(table(row(1, "A")), table(row(2, "B", tv=5)), True)
    said = screening.by_name(spark.createDataFrame([("g1", "City Hotel"), ("g2", "Plain Trade")], "gstin string, vendor_name string"))
    places = report.accept(clean, str(tmp_path / "a"), said)
    rows = spark.read.parquet(places["vendor_suggestions"]).collect()
    assert [(r["gstin"], r["reviewer_note"]) for r in rows] == [("g1", None)] and rows[0]["rule"] == "Vendor screening"
    blocked = report.propose(table(row(1, "A")), table(row(1, "A", text="canteen")), True)
    assert "vendor_suggestions" not in report.tables(blocked, said)


def test_typical_gaps_of_series_in_several_ranges(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for vendor in "VWX":
        picked = sorted(rng.sample(range(1, 5000), {"V": 400, "W": 5, "X": 3}[vendor]))
        days = {n: rng.randint(0, 90) for n in picked}
        rows += [(vendor, f"S/{n}", DAY + dt.timedelta(days=days[n])) for n in picked for _ in range(rng.randint(1, 2))]
        gaps = sorted(b - a for a, b in zip(picked, picked[1:], strict=False))
        if len(picked) >= 4:
            want[vendor] = (gaps[(len(picked) - 1) // 2], (picked[-1] - picked[0]) / (max(days.values()) - min(days.values())))
    got = {r["gstin"]: (r["median_gap"], r["per_day"]) for r in duplicates.typical_gaps(spark.createDataFrame(rows, "gstin string, identifier string, date date")).collect()}
    assert got == want


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """The smallest tables with supplier keys of five digits and one state for all: tax ids have room for four digits, so ten suppliers share one."""
    folder, con = tmp_path_factory.mktemp("crowded"), duckdb.connect()
    for name, changed in {"supplier": "s_suppkey + 10000 AS s_suppkey, 1::INTEGER AS s_nationkey", "lineitem": "l_suppkey + 10000 AS l_suppkey", "orders": "o_orderkey AS o_orderkey", "customer": "c_custkey AS c_custkey"}.items():
        con.execute(f"COPY (SELECT * REPLACE ({changed}) FROM '/root/testdata/sf0.001/{name}.parquet') TO '{folder}/{name}.parquet'")
    return folder


def equal_to_sql(spark, name, folder):
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = catalog.QUERIES[name](spark, str(folder))
    wanted = con.execute(f"SELECT {', '.join(found.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    return wanted and Counter(map(tuple, found.collect())) == Counter(wanted)


def test_notes_stay_with_their_row_where_entries_share_a_number(spark, crowded, table):
    assert equal_to_sql(spark, "reviewer_carry_forward", crowded)
    rows = table(row(1, "A"), row(2, "A"), row(3, "A")).select("row_index", "gstin", "identifier")
    notes = spark.createDataFrame([(G, "A", 2, "", "of 2"), (G, "A", 9, "", "of 9"), (G, "A", 10, "", "of 10"), (G, "A", 11, "", "of 11")], "gstin string, identifier string, row_index long, reviewer_status string, reviewer_note string")
    assert {(r["row_index"], r["reviewer_note"]) for r in report.carry_notes(rows, notes, ["gstin", "identifier"]).collect()} == {(1, "of 9"), (2, "of 2"), (3, "of 10")}
    assert [r["reviewer_note"] for r in report.orphaned_notes(rows, notes, ["gstin", "identifier"]).collect()] == ["of 11"]


def test_names_in_the_text_column_need_no_judging(spark, crowded, table):
    assert equal_to_sql(spark, "vendor_names_from_text", crowded)
    rows = table(*(row(10 * v + i, "A", gstin=f"V{v}", text=f"name {i}") for v in range(4) for i in range(3))).withColumn("trade_legal_name", F.lit(None).cast("string"))
    bare = rows.withColumn("particulars", F.lit(None).cast("string"))
    named = lambda known: {r["vendor_name"] for r in vendors.vendor_names(bare, rows, known).collect()}
    assert named(True) == {"name 0"} and named(None) == named(False) == set()


def test_breakdowns_need_no_duplicates(table, monkeypatch):
    p = report.propose(table(row(1, "A", igst=0, cgst=9_050, sgst=9_000, place="07-Delhi"), row(2, "C")), table(row(2, "B", tv=5)), True)
    want = report.top_issues(p).filter("breakdown is not null").collect()
    monkeypatch.setattr(duplicates, "on_both_sides", None)
    p = report.propose(p.gstr2a, p.books, True)
    assert want and sorted(report.issues_by_head(p).collect()) == sorted(want)


def test_numbers_that_stand_once_on_each_side_are_settled(table):
    a, b = table(row(1, "X-500"), row(2, "777"), row(3, "N/900")), table(row(1, "X-500"), row(2, "Z/777"), row(3, "M/901"))
    found = {r["identifier"]: (r["over_one"], r["over_two"]) for r in invoices.numbers(invoices.canonical(a), invoices.canonical(b)).collect()}
    assert found == {"777": ("Z/777", None), "Z/777": (None, "777"), "N/900": (None, None), "M/901": (None, None)}
    left = invoices.unmatched_on_both(invoices.canonical(a), invoices.canonical(b))
    assert [[r["identifier"] for r in side.collect()] for side in left] == [["N/900"], ["M/901"]]
    e = invoices.detect_extras(a, b)
    assert [tuple(r) for r in e.bridges().collect()] == [(G, "777", "Z/777")]


def test_amounts_beside_equal_all_pairs(spark):
    rng = random.Random(11)
    amounts = {(v, a): rng.randint(1, 3) for v in "VW" for a in (-6_401, -6_400, -1, 0, 99, 100, 6_299, 6_300, 6_399, 6_400, 6_500, *(rng.randint(-9_000, 30_000) for _ in range(150)))}
    rows = spark.createDataFrame([(v, a, n) for (v, a), n in amounts.items()], "gstin string, amount long, n long")
    for width in (0, 7, 100):
        want = {(v, a): sum(n for (w, b), n in amounts.items() if w == v and abs(a - b) <= width) for v, a in amounts}
        got = duplicates.amounts_beside(rows, width).collect()
        assert {(r["gstin"], r["amount"]): r["near"] for r in got} == want and len(got) == len(want)


def test_names_with_a_common_stem_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(matching, "TILE", 32)
    rng = random.Random(8)
    names = [f"Supplier#{rng.randint(0, 4_000):09d}" for _ in range(150)] + ["Supplier#1", "Supplies#000000001", "blue anvil", "blue anvils", "old gear"]
    rows = spark.createDataFrame([(n,) for n in names], "x string").distinct()
    sides = [rows.select(F.col("x").alias(n), F.length("x").alias(length)) for n, length in (("name", "m"), ("other", "n"))]
    dense = matching.dense_lengths(*matching.name_pieces(rows, rows, 80), *sides)
    assert (18, 18) in {(r["m"], r["n"]) for r in dense.collect()}
    paired = rows.crossJoin(rows.toDF("y")).withColumn("s", identifiers.similarity_percent(F.col("x"), F.col("y"))).filter("s >= 80")
    got = matching.similar_names(rows, rows, 80).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, paired.collect())) and len(got) > 5_000


def test_names_one_letter_apart_need_no_pairs(spark):
    rng = random.Random(6)
    names = ["", None, " Ab ", "abcde", "abcdE", "ABXDE", "abcd", "abcx", "x" * 200, "x" * 199 + "y", "é" * 9, "é" * 8 + "e"] + ["".join(rng.choice("abc") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    left, right = spark.createDataFrame([(n,) for n in names[:50]], "x string"), spark.createDataFrame([(n,) for n in names[30:] + names[:12]], "y string")
    paired = left.crossJoin(right).select("x", F.lower(F.trim("x")).alias("a"), F.lower(F.trim("y")).alias("b"), identifiers.similarity_percent(F.col("x"), F.col("y")).alias("s"))
    want = {r["x"] for r in paired.filter("length(a) = length(b) and levenshtein(a, b) = 1 and s between 80 and 99").collect()}
    rows = matching.one_letter_apart(left, right, 80).collect()
    assert {r["x"] for r in rows} == want and len(rows) == len(want) and want
    many = [spark.range(400).select(F.concat(F.lit("Supplier#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("x")) for _ in range(2)]
    assert matching.one_letter_apart(*many, 80).count() == 400
