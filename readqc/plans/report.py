"""One HTML page of a profile.

Only aggregates reach the driver: positions (clustered beyond 250) x series x classes, whatever the file's size.
The page holds its data as JSON and a short script that draws it; it needs no network.
"""

from __future__ import annotations

import datetime
import html
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from readqc import __version__
from readqc.functions import reads as R
from readqc.operators import derive as D
from readqc.operators import profiles as P
from readqc.plans.profile import Profile
from readqc.sources.files import size_and_time

PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font-family:sans-serif;max-width:60em;margin:auto}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:.2em .6em;text-align:right}}
.banner{{background:#fec;padding:.5em}}button.on{{font-weight:bold}}svg{{background:#fafafa}}footer{{margin-top:3em;color:#777}}</style></head><body>
<h1>{title}</h1><p>{file_line}</p><p>readqc {version}</p>
{body}
<footer>readqc {version}</footer>
<script>
const colours=["#3366cc","#dc3912","#ff9900","#109618","#990099"];
const view=250;
function draw(plot,group,from){{
  const box=document.getElementById(plot.id),full=plot.groups[group],w=900,h=260,all=plot.labels.length,slides=!plot.density&&all>view+1;
  from=from||0;const to=slides?Math.min(from+view+1,all):all,labels=plot.labels.slice(from,to),n=labels.length;
  const g={{traces:full.traces.map(t=>({{name:t.name,y:t.y.slice(from,to),error:t.error&&t.error.slice(from,to)}}))}};
  let low=0,high=0;const sums=Array(n).fill(0);
  g.traces.forEach(t=>t.y.forEach((v,i)=>{{sums[i]+=v;high=Math.max(high,plot.kind=="bar"?sums[i]:v+(t.error?t.error[i]:0))}}));
  const x=i=>40+(w-50)*i/Math.max(n,1),y=v=>h-20-(h-30)*(v-low)/((high-low)||1);let s="";const base=Array(n).fill(0);
  g.traces.forEach((t,k)=>{{const c=colours[k%5];
    if(plot.kind=="bar")t.y.forEach((v,i)=>{{if(v){{s+=`<rect x="${{x(i)}}" width="${{Math.max((w-50)/n-.5,.5)}}" y="${{y(base[i]+v)}}" height="${{y(base[i])-y(base[i]+v)}}" fill="${{c}}"><title>${{labels[i]}} ${{t.name}} ${{v}}</title></rect>`;base[i]+=v}}}});
    else{{s+=`<polyline fill="none" stroke="${{c}}" points="${{t.y.map((v,i)=>x(i+.5)+","+y(v)).join(" ")}}"/>`;
      if(t.error)t.y.forEach((v,i)=>s+=`<line x1="${{x(i+.5)}}" x2="${{x(i+.5)}}" y1="${{y(v-t.error[i])}}" y2="${{y(v+t.error[i])}}" stroke="${{c}}"/>`)}}}});
  s+=`<text x="0" y="12" font-size="10">${{high.toPrecision(4)}}</text><text x="40" y="${{h-5}}" font-size="10">${{labels[0]||""}}</text><text x="${{w-80}}" y="${{h-5}}" font-size="10">${{labels[n-1]||""}}</text>`;
  box.innerHTML=plot.groups.map((q,i)=>plot.groups.length>1?`<button class="${{i==group?"on":""}}" data-g="${{i}}">${{q.name}}</button>`:"").join("")+`<svg width="${{w}}" height="${{h}}">${{s}}</svg><div>${{g.traces.map((t,k)=>`<span style="color:${{colours[k%5]}}">${{t.name}}</span>`).join(" ")}}</div>`+(slides?`<input type="range" min="0" max="${{all-view-1}}" value="${{from}}" style="width:${{w}}px" title="first position shown">`:"");
  const slider=box.querySelector("input");if(slider)slider.oninput=()=>{{draw(plot,group,+slider.value);box.querySelector("input").focus()}};
  box.querySelectorAll("button").forEach(b=>b.onclick=()=>draw(plot,+b.dataset.g));
}}
const plots={plots};plots.forEach(p=>draw(p,0));
</script></body></html>
"""


def file_line(spark: SparkSession, path: str) -> str:
    """Size and time of change, wherever the file is; its content is not read."""
    found = size_and_time(spark, path)
    if found is None:
        return html.escape(path)
    return f"{html.escape(path)}: {found[0]} bytes, {datetime.datetime.fromtimestamp(found[1] / 1000, datetime.UTC):%Y-%m-%d %H:%M:%S}"


def identifier(*parts) -> str:
    return "".join("_" if c.isspace() else c for c in "_".join(map(str, parts)))


def _labels(extent: int, clusters: dict) -> list[str]:
    return [clusters.get(i, str(i)) for i in range(extent)]


def _plot(name: str, mate: int, kind: str, rows: list, traces) -> dict | None:
    """Classes with data in order; traces makes those of one class from its rows and the number of positions."""
    extent = 1 + max((r["cluster"] for r in rows), default=-1)
    classes: dict = {}
    for r in rows:
        classes.setdefault(r["mapq_bin"], []).append(r)
    groups = [{"name": R.MAPQ_LABELS[c], "traces": t} for c in sorted(classes) if (t := traces(classes[c], extent))]
    if not groups:
        return None
    labels = {r["cluster"]: r["label"] for r in rows}
    return {"id": identifier(name, mate), "kind": kind, "labels": [labels.get(i, str(i)) for i in range(extent)], "groups": groups}


def count_traces(names):
    """A dense trace for each series with data."""

    def traces(rows: list, extent: int) -> list:
        found: dict = {}
        for r in rows:
            if r["n"]:
                found.setdefault(r["series"], [0] * extent)[r["cluster"]] = r["n"]
        return [{"name": names(s), "y": found[s]} for s in sorted(found)]

    return traces


def mean_traces(rows: list, extent: int) -> list:
    y, error = [0.0] * extent, [0.0] * extent
    for r in rows:
        y[r["cluster"]], error[r["cluster"]] = r["mean"], r["std_err"]
    return [{"name": "mean quality", "y": y, "error": error}]


#: Files whose counts are brought to the driver at once.
FILES = 500


@dataclass
class Summary:
    """What a page shows of one file: pair counts, mapping table, rows of the plots by (what, mate), densities by mate, and
    issue -> (number, bytes)."""

    pairs: Row
    mapping: list = field(default_factory=list)
    rows: dict = field(default_factory=dict)
    densities: dict = field(default_factory=dict)
    issues: dict = field(default_factory=dict)


def summaries(cells: DataFrame) -> dict[str, Summary]:
    """file -> Summary out of the cells of several files, in two collects: a row for each file, and the plots' points (at most
    clusters x series x classes of each file, and its distinct lengths)."""
    what = F.col("what")
    bad = what.startswith(P.ISSUE) | what.startswith(P.LOST)
    numbers = P.pairs_of(cells, ["file"])
    mapping = D.mapping_table(cells.where("what = 'reads'").select("file", *D.KEY, "n"), ["file"]).groupBy("file").agg(F.collect_list(F.struct("read_no", "class", "n", "fraction")).alias("mapping"))
    issues = cells.where(bad).groupBy("file", "what").agg(F.sum("n").alias("n")).groupBy("file").agg(F.collect_list(F.struct("what", "n")).alias("issues"))
    out = {r["file"]: Summary(r, r.mapping or [], issues=_issues(r.issues or [])) for r in numbers.join(mapping, "file", "left").join(issues, "file", "left").collect()}

    by = ["file", "what", *D.KEY]
    longest = cells.where("what = 'raw_lengths'").groupBy("file").agg(F.max("pos").alias("longest"))
    shown = cells.where(~what.isin(*P.NUMBERS) & ~bad).join(longest, "file", "left")
    matrix = F.when(what.endswith("normalised"), R.NORM_BINS).otherwise(F.greatest(F.lit(R.EXACT), F.coalesce("longest", F.lit(0)) + 1))
    clustered = D.clustered_by_file(shown.withColumn("l", R.matrix_length(matrix - 1)), by).where("n > 0")
    of_qualities = what.startswith("qualities")
    none = F.lit(None).cast("double")
    plain = clustered.where(~of_qualities).select(*by, "cluster", "label", "series", "n", none.alias("mean"), none.alias("std_err"))
    means = D.mean_quality(clustered.where(of_qualities).withColumnRenamed("cluster", "pos"), [*by, "label"]).select(*by, F.col("pos").alias("cluster"), "label", F.lit(0).alias("series"), "n", "mean", "std_err")
    lengths = D.length_density(cells.where("what = 'lengths'").select("file", *D.KEY, F.col("pos").alias("len"), "n"), ["file", *D.KEY])
    density = lengths.select("file", F.lit("lengths").alias("what"), *D.KEY, F.col("len").alias("cluster"), F.lit("").alias("label"), F.lit(0).alias("series"), F.lit(0).cast("long").alias("n"), F.col("density").alias("mean"), none.alias("std_err"))
    points: dict = {}
    for r in plain.unionByName(means).unionByName(density).collect():
        if r["what"] == "lengths":
            points.setdefault(r["file"], []).append(r)
        else:
            out[r["file"]].rows.setdefault((r["what"], r.read_no), []).append(r.asDict())
    for f, rows in points.items():
        out[f].densities = density_plots(rows)
    return out


def _issues(rows: list) -> dict:
    found = {r["what"]: r["n"] for r in rows}
    return {w.removeprefix(P.ISSUE): (n, found.get(P.LOST + w.removeprefix(P.ISSUE), 0)) for w, n in found.items() if w.startswith(P.ISSUE)}


def gathered(profiles: dict[str, Profile]) -> Iterator[tuple[str, Summary]]:
    """(path, Summary) of every file, FILES of one plan at once."""
    plans: dict = {}
    for p, x in profiles.items():
        plans.setdefault(id(x.cells if x.shared is None else x.shared), []).append(p)
    for paths in plans.values():
        for i in range(0, len(paths), FILES):
            some = paths[i : i + FILES]
            first = profiles[some[0]]
            cells = first.cells.withColumn("file", F.lit(some[0])) if first.shared is None else first.shared if len(some) == len(paths) else first.shared.where(F.col("file").isin(*some))
            found = summaries(cells)
            for p in some:
                yield p, found.get(p) or _empty()


def _empty() -> Summary:
    """Of a file without any record."""
    return Summary(Row(total=0, n_read1=0, n_read2=0, n_paired=0, n_proper=0, pct_paired=None, pct_proper=None))


def density_plots(rows: list) -> dict:
    """mate -> plot, of the densities (mean) at lengths (cluster)."""
    out: dict = {}
    for mate in sorted({r.read_no for r in rows}):
        own = sorted((r for r in rows if r.read_no == mate), key=lambda r: (r.mapq_bin, r.cluster))
        at = {n: i for i, n in enumerate(sorted({r.cluster for r in own}))}
        groups = []
        for c in sorted({r.mapq_bin for r in own}):
            y = [0.0] * len(at)
            for r in own:
                if r.mapq_bin == c:
                    y[at[r.cluster]] = r["mean"]
            groups.append({"name": R.MAPQ_LABELS[c], "traces": [{"name": "density", "y": y}]})
        out[mate] = {"id": identifier("lengths", mate), "kind": "line", "labels": list(map(str, at)), "groups": groups, "density": True}
    return out


def _human(n: int) -> str:
    for by, unit in ((10**9, "G"), (10**6, "M"), (10**3, "K")):
        if n >= by:
            return f"{int(n / by + 0.5)}{unit}"
    return str(n)


def mapping_section(p: Profile, s: Summary) -> str:
    """The counts of reads, as a table for aligned files."""
    pairs, rows = s.pairs, s.mapping
    if not p.aligned:
        return f"<h2>Reads</h2><p>{_human(pairs.total)} reads</p>"
    order = {name: i for i, name in enumerate((*R.MAPQ_LABELS, "Total"))}
    out = ["<h2>Mapping statistics</h2><p>", f"{_human(pairs.total)} reads", f", {pairs.pct_paired}% paired" if pairs.n_paired else "", f", {pairs.pct_proper}% of these properly" if pairs.n_paired else "", "</p><table><tr><th>Mate</th><th>Class</th><th>Reads</th><th>Fraction</th></tr>"]
    for r in sorted(rows, key=lambda r: (r.read_no, order[r["class"]])):
        out.append(f"<tr><td>{r.read_no}</td><td>{r['class']}</td><td>{_human(r.n)}</td><td>{'' if r.fraction is None else f'{r.fraction:.5f}'}</td></tr>")
    return "".join(out) + "</table>"


def render(p: Profile, s: Summary | None = None) -> str:
    """The page of one profile: what has no data is left out. Second mates are shown where any read is paired; titles
    name the mate where there are second mates."""
    s = s or dict(gathered({p.path: p}))[p.path]
    pairs, rows = s.pairs, s.rows
    body = [mapping_section(p, s)]
    for issue, (n, lost) in sorted(s.issues.items()):
        body.append(f'<p class="banner">Left out: {html.escape(issue)}, {n} times, {lost} bytes.</p>')
    if p.partial:
        body.append(f'<p class="banner">This report is partial: it shows the first {pairs.total} reads only.</p>')
    base = count_traces(lambda s: R.BASES[s])
    plots: list = []
    mates = (1, 2) if p.aligned and pairs.n_paired else (1,)

    def add(title: str, make) -> None:
        for mate in mates:
            if plot := make(mate):
                plots.append(plot)
                body.append(f'<h2>{title}{f" Read {mate}" if pairs.n_read2 else ""}</h2><div id="{plot["id"]}"></div>')

    def by_position(title: str, name: str, what: str, kind: str, traces) -> None:
        add(title, lambda m: _plot(name, m, kind, rows.get((what, m), []), traces))

    add("Length distribution", s.densities.get)
    by_position("Base composition", "bases", "bases", "bar", base)
    by_position("Base quality", "qualities", "qualities", "line", mean_traces)
    if p.options.plot_end:
        by_position("Base composition from the read's end", "end bases", "bases_from_end", "bar", base)
        by_position("Base quality from the read's end", "end qualities", "qualities_from_end", "line", mean_traces)
    if p.options.norm:
        by_position("Base composition by hundredths of the read", "norm bases", "bases_normalised", "bar", base)
        by_position("Base quality by hundredths of the read", "norm qualities", "qualities_normalised", "line", mean_traces)
    if p.aligned:
        by_position("Mismatches", "mismatches", "mismatches", "bar", base)
        by_position("Insertions", "insertions", "insertions", "line", count_traces(lambda s: "insertions"))
        by_position("Deletions", "deletions", "deletions", "line", count_traces(lambda s: "deletions"))
    title = html.escape(os.path.basename(p.path))
    data = json.dumps(plots).replace("</", "<\\/")
    return PAGE.format(title=title, file_line=file_line(p.cells.sparkSession, p.path), version=__version__, body="\n".join(body), plots=data)
