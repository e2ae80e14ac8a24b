"""From workbook cells to a proposal: recognise sheets and columns, ask what stays open, reconcile.

A field that is in doubt is looked up in the client's memory, then in the other
sheets of the workbook, then in patterns shared between clients.  If it stays
open, ``ColumnsUnresolved`` names it and nothing is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import report, row_rules
from ledgerloom.plans.memory import BestEffort, ColumnsUnresolved, Memory, Patterns, SheetLabel, corroborated, pattern_key, sheet_label
from ledgerloom.plans.recognition import Column, ColumnMap, Verdict, classify_sheet, identify_columns, normalized_header, open_fields, pick_sheets, read_sheets, recognize_role
from ledgerloom.plans.staging import staged
from ledgerloom.sources.cells import header_rows
from ledgerloom.sources.sheets import invoices

# Workflows in the order in which they are tried: the side of a proposal that each role's sheet becomes.
WORKFLOWS = {"gstr2a_vs_books": {"gstr2a": "gstr2a", "purchase_register": "books"}}
# Checks of single rows that run on both sides of any workflow.
ONE_OF = (("igst", "cgst", "sgst"), ("invoice_number", "voucher_number"))
VALIDATORS: dict[str, Callable[[DataFrame], DataFrame]] = {"rate_mismatch": row_rules.rate_mismatch}


def validated(sources: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What each standing check finds on all ``sources``, with the source's name."""
    found = {}
    for name, check in VALIDATORS.items():
        parts = [check(rows).withColumn("source", F.lit(source)) for source, rows in sources.items()]
        found[name] = parts[0]
        for part in parts[1:]:
            found[name] = found[name].unionByName(part)
    return found


@dataclass
class Recognized:
    """Sheets of a workbook, what they hold, the first workflow that has a sheet for each role, and these (None if there is no such workflow)."""

    columns: dict[str, list[Column]]
    maps: dict[str, ColumnMap]
    roles: dict[str, Verdict]
    chosen: dict[str, str] | None
    headers: dict[str, int] = field(default_factory=dict)
    labels: dict[str, SheetLabel] = field(default_factory=dict)
    workflow: str | None = None


def recognize(cells: DataFrame, client_id: str | None = None, labels: Memory | None = None, shared: Patterns | BestEffort | None = None) -> Recognized:
    """Roles come from the columns; a sheet that they do not tell has the role that ``labels`` or ``shared`` remember for sheets like it, if that is one.

    ``labels`` of the result say of every sheet what it is and how that is known.
    """
    sheets = read_sheets(cells)
    maps = {name: identify_columns(columns) for name, columns in sheets.items()}
    roles = {name: recognize_role(m) for name, m in maps.items()}
    named: dict[str, SheetLabel] = {}
    for name, columns in sheets.items():
        kind = roles[name].kind if roles[name].kind != "unknown" else classify_sheet(columns).kind
        named[name] = sheet_label(labels or Memory(), client_id or "", columns, kind, shared)
        if roles[name].kind == "unknown" and named[name].status == "remembered" and any(named[name].label in sides for sides in WORKFLOWS.values()):
            roles[name] = Verdict(named[name].label, "medium")
    headers = {r["sheet"]: r["header_ix"] for r in header_rows(cells).collect()}
    for workflow, sides in WORKFLOWS.items():
        if chosen := pick_sheets(roles, sides):
            return Recognized(sheets, maps, roles, chosen, headers, named, workflow)
    return Recognized(sheets, maps, roles, None, headers, named)


def resolve_columns(found: Recognized, role: str, client_id: str, memory: Memory, shared: Patterns | BestEffort) -> tuple[dict[str, int], list[tuple[str, str]]]:
    """Places of all fields of a role's sheet, and ``(field, reason)`` of those that stay open."""
    sheet = found.chosen[role]
    columns, m = found.columns[sheet], found.maps[sheet]
    places = dict(m.found)
    if m.dates:
        places["date"] = m.dates[0]
    known = memory.columns(client_id, columns)
    headers = {c.index: c.header for c in columns}
    peers = [s for s, verdict in found.roles.items() if s != sheet and verdict.kind == role]
    asked: list[tuple[str, str]] = []
    for name, reason in open_fields(role, m):
        if name in known:
            continue
        candidates = [headers[i] for i in m.candidates[name]] or list(headers.values())
        others = [_header(found, s, found.maps[s].candidates[name][0]) for s in peers if len(found.maps[s].candidates[name]) == 1]
        how, header = corroborated(candidates, others)
        if how != "exact":
            header = shared.get(pattern_key(name, candidates)) if reason == "ambiguous" else None
        at = next((i for i, h in headers.items() if header is not None and normalized_header(h) == normalized_header(header)), None)
        if at is None:
            asked.append((name, reason))
        else:
            known[name] = at
    settled = {name for group in ONE_OF for name in group if any(n in known for n in group)}
    return places | known, [(name, reason) for name, reason in asked if reason == "ambiguous" or name not in settled]


def _header(found: Recognized, sheet: str, index: int) -> str:
    return next(c.header for c in found.columns[sheet] if c.index == index)


def reconcile_workbook(cells: DataFrame, client_id: str, memory: Memory | None = None, shared: Patterns | BestEffort | None = None, labels: Memory | None = None) -> report.Proposal:
    """Reconcile the statement with the purchase register of a workbook. ``memory``: answers about columns; ``labels``: of sheets. ``ValueError`` if a role has no sheet."""
    found = recognize(cells, client_id, labels, shared)
    if found.chosen is None:
        raise ValueError(f"no sheet for each role: {({s: v.kind for s, v in found.roles.items()})}")
    sides = {}
    for role, side in WORKFLOWS[found.workflow].items():
        sheet = found.chosen[role]
        places, asked = resolve_columns(found, role, client_id, memory or Memory(), shared or Patterns())
        if asked:
            raise ColumnsUnresolved(sheet, asked)
        sides[side] = staged(invoices(cells, sheet, found.headers[sheet], places), side)
    return report.propose(sides["gstr2a"], sides["books"])


def answer(found: Recognized, sheet: str, name: str, index: int, client_id: str, memory: Memory, shared: Patterns | BestEffort, audit_path: str | None = None, cells: DataFrame | None = None) -> None:
    """Remember an answer for the client; an ambiguous field is shared with all clients too. With ``audit_path`` the answer is logged."""
    columns, m = found.columns[sheet], found.maps[sheet]
    memory.answer(client_id, columns, sheet, name, index)
    if len(m.candidates[name]) >= 2:
        shared.remember(pattern_key(name, [_header(found, sheet, i) for i in m.candidates[name]]), _header(found, sheet, index))
    if audit_path and cells is not None:
        row = cells.sparkSession.range(1).select(F.current_timestamp().alias("at"), F.lit(sheet).alias("sheet"), F.lit(name).alias("place"), F.lit(_header(found, sheet, index)).alias("text"))
        report.append_audit(row, audit_path)
