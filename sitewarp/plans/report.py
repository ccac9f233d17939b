"""Reports: one nested row per site, and JSON, Markdown and HTML sinks."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewarp.operators import findings as O

LEAST_FREE = 64 * 1024 * 1024


def site_reports(ranked: DataFrame, pages: DataFrame, suppressed: DataFrame, limitations: DataFrame) -> DataFrame:
    """(site, status, n_pages, n_findings, findings, counts, suppressions, limitations): arrays are sorted, so the same input
    gives the same bytes. A site without findings still has its row; limitations make its status partial."""
    item = F.struct("finding_id", "check_id", "title", "severity", "confidence", "stage", "category", "scope", "affected_urls", "evidence", "priority", "ice", "blocked_by")
    found = ranked.groupBy("site").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    counted = O.counts(ranked).groupBy("site").agg(F.array_sort(F.collect_list(F.struct("dimension", "value", "n"))).alias("counts"))
    skips = suppressed.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("check_id", "reason", "n"))).alias("suppressions"))
    limits = limitations.groupBy("site").agg(F.array_sort(F.collect_set(F.struct("check_id", "reason"))).alias("limitations"))
    out = pages
    for part in (found, counted, skips, limits):
        out = out.join(part, "site", "left")
    return out.select("site", F.when(F.col("limitations").isNull(), "complete").otherwise("partial").alias("status"), "n_pages", F.coalesce(F.size("findings"), F.lit(0)).cast("bigint").alias("n_findings"), "findings", "counts", "suppressions", "limitations")


def write_json(reports: DataFrame, folder: str) -> None:
    """One JSON object per site, a folder per site."""
    reports.write.mode("overwrite").partitionBy("site").json(folder)


def guard(folder: str, least_free: int = LEAST_FREE) -> None:
    """Refuses a local folder on a nearly full disk."""
    os.makedirs(folder, exist_ok=True)
    stat = os.statvfs(folder)
    if stat.f_bavail * stat.f_frsize < least_free:
        raise OSError(f"less than {least_free} bytes free at {folder}")


def markdown(report: dict, top: int = 5) -> str:
    """A report row (as a dict) as Markdown: the first actionable findings, counts, gates, all findings, what was not assessed."""
    rows = report.get("findings") or []
    lines = [f"# {report['site']}", "", f"{report['n_pages']} pages, {len(rows)} findings, {report['status']}.", ""]
    if first := [f for f in rows if not f["blocked_by"]][:top]:
        lines += ["## First", "", *(f"{i}. {f['finding_id']} {f['title']} ({f['severity']})" for i, f in enumerate(first, 1)), ""]
    severities = [c for c in report.get("counts") or [] if c["dimension"] == "severity"]
    lines += ["| severity | findings |", "|---|---|", *(f"| {c['value']} | {c['n']} |" for c in severities), ""]
    for stage in O.STAGE:
        if own := [f for f in rows if f["stage"] == stage]:
            lines += [f"## {stage}", ""]
            for f in own:
                held = f" Held back by {f['blocked_by']}." if f["blocked_by"] else ""
                lines.append(f"- **{f['finding_id']} {f['title']}** {f['severity']}, {f['confidence']}. {f['evidence']}.{held}")
            lines.append("")
    if skips := report.get("suppressions"):
        lines += ["## Not assessed", "", *(f"- {s['check_id']}: {s['reason']} ({s['n']})" for s in skips), ""]
    return "\n".join(lines)


def page(report: dict) -> str:
    """A report row as a self-contained, escaped HTML page."""
    cell = lambda x: f"<td>{html.escape(str(x if x is not None else ''))}</td>"
    rows = "".join("<tr>" + "".join(cell(f[k]) for k in ("finding_id", "severity", "title", "evidence", "blocked_by")) + "</tr>" for f in report.get("findings") or [])
    site = html.escape(report["site"])
    return f"<!doctype html><meta charset=utf-8><title>{site}</title><h1>{site}</h1><p>{report['n_pages']} pages, {report['status']}</p><table><tr><th>id<th>severity<th>finding<th>evidence<th>blocked by</tr>{rows}</table>"


def write_pages(reports: DataFrame, folder: str) -> None:
    """JSON, Markdown and HTML of every site below a shared ``folder``, written where the rows are: nothing passes the driver.
    Each file is written aside and renamed, so a lost executor leaves no half a file."""
    guard(folder)

    def run(rows) -> None:
        for row in rows:
            report = row.asDict(recursive=True)
            name = "".join(c if c.isalnum() or c in ".-" else "-" for c in report["site"])
            for ending, text in (("json", json.dumps(report, sort_keys=True, indent=2, default=str)), ("md", markdown(report)), ("html", page(report))):
                target = os.path.join(folder, f"{name}.{ending}")
                with open(f"{target}.{os.getpid()}", "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(f"{target}.{os.getpid()}", target)

    reports.foreachPartition(run)
