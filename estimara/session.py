"""A working table with its stored estimates and notes, comparison tables, and projects that can be replayed.

Commands are methods, and a recorded command is its name with its arguments as
JSON, so there is no command language to parse.
"""

from __future__ import annotations

import hashlib
import json
import math
import platform
import re
import uuid
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import StatError, unknown_variable
from .operators import describe, frame, glm, hypothesis, linear, panel
from .operators.linear import Fit
from .plans.staging import stage
from .sources import csvio
from .sources.paged import PagedTable
from .sources.store import Store

#: Changes of the table after which its plan is cut.
MUTATIONS = 30
HELP = {
    "use": "load a CSV or Parquet table", "summarize": "n, mean, spread, quartiles and shape of variables", "describe": "names, types and labels", "correlate": "Pearson or Spearman correlations",
    "ttest_one": "mean against a number", "ttest_by": "two groups", "ttest_two": "two variables", "ttest_paired": "differences of two variables", "anova": "one-way analysis of variance",
    "regress": "linear regression", "xtreg": "panel: fe, be or pooled", "ivregress": "two-stage least squares", "did": "difference in differences", "glm": "logit, probit or poisson",
    "generate": "a new variable", "replace": "new values", "drop_vars": "delete variables", "keep_vars": "keep variables", "drop_if": "delete rows", "keep_if": "keep rows", "rename": "a new name", "label_variable": "a description",
    "sort": "row order", "estimates_list": "stored models", "compare": "models side by side", "export_table": "a publication table", "export_data": "the table as a file", "note": "keep a remark", "notes": "show remarks", "frequency": "counts of values", "histogram": "counts in equal-width bins", "scatter": "pairs of finite numbers",
}


#: Commands whose records may be replayed.
RECORDED = {"summarize", "correlate", "ttest_one", "ttest_by", "ttest_two", "ttest_paired", "anova", "regress", "xtreg", "ivregress", "did", "glm"}


@dataclass
class Estimate:
    id: str
    label: str
    command: str
    fit: Fit


@dataclass
class Comparison:
    ids: list[str]
    labels: list[str]
    terms: list[str]
    cells: list[dict[str, tuple[float, float, float]]]  # by model: term -> coef, se, p
    n: list[int]
    fit: list[str]

    def to_df(self, spark: SparkSession) -> DataFrame:
        rows = [(i, t, *cells[t]) for i, cells in zip(self.ids, self.cells) for t in self.terms if t in cells]
        return spark.createDataFrame(rows, "model string, term string, coef double, se double, p double")


def fit_line(fit: Fit) -> str:
    f = fit.figures
    if fit.kind in ("ols", "wls"):
        return f"N = {fit.n}, R² = {f['r2']:.3f}"
    if "pseudo_r2" in f:
        return f"N = {fit.n}, pseudo-R² = {f['pseudo_r2']:.3f}"
    if "r2_within" in f:
        return f"N = {fit.n}, entities = {f['groups']}, R²(within) = {f['r2_within']:.3f}"
    return f"N = {fit.n}"


def stars(p: float) -> str:
    return "***" if p < 0.001 else "**" if p < 0.01 else "*" if p < 0.05 else ""


def escaped(text: str, marks: dict[str, str]) -> str:
    return "".join(marks.get(c, c) for c in text)


def render_table(c: Comparison, kind: str) -> str:
    """Coefficients with stars, standard errors in parentheses below; md, csv (full digits), tex or html."""
    coef = lambda cells, t: f"{cells[t][0]:.3f}{stars(cells[t][2])}" if t in cells else ""
    error = lambda cells, t: f"({cells[t][1]:.3f})" if t in cells else ""
    body = [(t, [coef(m, t) for m in c.cells], [error(m, t) for m in c.cells]) for t in c.terms]
    if kind == "md":
        row = lambda cells: f"| {' | '.join(cells)} |"
        lines = [row(["Term", *c.ids]), "|---|" + "---:|" * len(c.ids)]
        for t, a, b in body:
            lines += [row([t, *a]), row(["", *b])]
        lines += [row(["N", *map(str, c.n)]), row(["Fit", *c.fit]), "", r"*Significance: \*\*\* p<0.001, \*\* p<0.01, \* p<0.05.*"]
    elif kind == "csv":
        lines = [",".join(["term", *(f"{i}_{what}" for i in c.ids for what in ("coef", "se", "p"))])]
        lines += [",".join([t, *(",".join(map(repr, m[t])) if t in m else ",," for m in c.cells)]) for t in c.terms]
        lines += [",".join(["N", *(f"{n},," for n in c.n)])]
    elif kind == "tex":
        marks = {x: f"\\{x}" for x in "_&%#$"}
        row = lambda cells: " & ".join(cells) + r" \\"
        lines = [r"\begin{tabular}{l" + "c" * len(c.ids) + "}", r"\toprule", row(["", *(f"({escaped(i, marks)})" for i in c.ids)]), r"\midrule"]
        for t, a, b in body:
            lines += [row([escaped(t, marks), *a]), row(["", *b])]
        lines += [r"\midrule", row(["N", *map(str, c.n)]), r"\bottomrule", r"\end{tabular}"]
    elif kind == "html":
        marks = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}
        row = lambda head, cells: f"<tr>{head}{''.join(f'<td>{x}</td>' for x in cells)}</tr>"
        lines = ["<table>", f"<thead><tr><th>Term</th>{''.join(f'<th>{escaped(i, marks)}</th>' for i in c.ids)}</tr></thead>", "<tbody>"]
        for t, a, b in body:
            lines += [row(f"<th>{escaped(t, marks)}</th>", a), row("<td></td>", b)]
        lines += [row("<th>N</th>", map(str, c.n)), "</tbody>", "</table>"]
    else:
        raise StatError("invalid_request", f"'.{kind}' is no table format.", "Tables are written as md, csv, tex or html.", "Change the ending.")
    return "\n".join(lines) + "\n"


@dataclass
class Session:
    spark: SparkSession
    data: DataFrame | None = None
    estimates: list[Estimate] = field(default_factory=list)
    remarks: list[str] = field(default_factory=list)
    project: Project | None = None
    _changes: int = 0
    _order: list[tuple[str, bool]] = field(default_factory=list)
    _paged: tuple[DataFrame, PagedTable] | None = None
    _filled: DataFrame | None = None

    # Data

    def use(self, path: str) -> csvio.ImportReport | None:
        if path.lower().rstrip("/").endswith(".parquet"):
            self.data, self._order = csvio.read_parquet(self.spark, path), []
            return None
        self._order = []
        self.data, report = csvio.read_csv(self.spark, path)
        return report

    @property
    def table(self) -> DataFrame:
        if self.data is None:
            raise StatError("invalid_request", "There are no data.", "The command needs a table.", "Load one with use.")
        return self.data

    @property
    def df(self) -> DataFrame:
        """The table for an analysis, which needs rows; that is looked up once for each state of the table."""
        if self._filled is not self.table:
            if not self.table.limit(1).count():
                raise StatError("insufficient_data", "The table is empty.", "The command needs rows.", "Load another, or check what was dropped.")
            self._filled = self.table
        return self.table

    def _set(self, df: DataFrame, change: str = "", **arguments: Any) -> None:
        if self.project and change:
            self.project.append_change(change, arguments)
        self._changes += 1
        if self._changes >= MUTATIONS:
            df, self._changes = stage(df, "session"), 0
        self.data = df

    # Changes of the table. With a project, each is recorded, and replayed; expressions as SQL text that has been read back.

    def _told(self, value: Column | str | None) -> str | None:
        """The expression as text: only where a project keeps it."""
        return expression_text(self.table, value) if self.project and value is not None else None

    def generate(self, name: str, value: Column | str) -> None:
        self._set(frame.generate(self.table, name, column(value)), "generate", name=name, value=self._told(value))

    def replace(self, name: str, value: Column | str, where: Column | str | None = None) -> None:
        self._set(frame.replace(self.table, name, column(value), column(where)), "replace", name=name, value=self._told(value), where=self._told(where))

    def drop_vars(self, *names: str) -> None:
        self._set(frame.drop_vars(self.table, list(names)), "drop_vars", names=list(names))

    def keep_vars(self, *names: str) -> None:
        self._set(frame.keep_vars(self.table, list(names)), "keep_vars", names=list(names))

    def drop_if(self, where: Column | str) -> None:
        self._set(frame.drop_if(self.table, column(where)), "drop_if", where=self._told(where))

    def keep_if(self, where: Column | str) -> None:
        self._set(frame.keep_if(self.table, column(where)), "keep_if", where=self._told(where))

    def rename(self, old: str, new: str) -> None:
        self._set(frame.rename(self.table, old, new), "rename", old=old, new=new)
        self._order = [(new if n == old else n, d) for n, d in self._order]

    def label_variable(self, name: str, label: str) -> None:
        self._set(frame.label_variable(self.table, name, label), "label_variable", name=name, label=label)

    def sort(self, name: str, descending: bool = False, ties: list[str] | None = None) -> None:
        """Rows with equal values stay in the order that they have by earlier sorts."""
        keys = [(name, descending), *((t, False) for t in ties or [])]
        keys += [k for k in self._order if k[0] not in {n for n, _ in keys}]
        self._set(self.table.orderBy(*frame.sort_keys(self.table, keys)), "sort", name=name, descending=descending, ties=ties)
        self._order = keys

    def preview(self, offset: int = 0, limit: int = 50) -> DataFrame:
        """Rows in the order of the sorts so far. Pages after the first come from a paged copy of the table, made once for each state of it."""
        df, keys = self.df, [k for k in self._order if k[0] in self.table.columns]
        if not offset:
            return (df.orderBy(*frame.sort_keys(df, keys)) if keys else df).limit(limit)
        if self._paged is None or self._paged[0] is not df:
            self._paged = (df, PagedTable.of(df, frame.sort_keys(df, keys) if keys else None))
        return self._paged[1].page(offset, limit)

    def profile(self, name: str) -> DataFrame:
        """A summary of a number, frequencies of a text."""
        frame.check_names(self.df, [name])
        return self.frequency(name) if frame.is_text(self.df, name) else self.summarize([name])

    # Statistics. With a project, summaries, correlations and tests are recorded like models.

    def _noted(self, command: str, arguments: dict[str, Any], result: DataFrame) -> DataFrame:
        if self.project:
            self.project.append(command_text(command, arguments), rows_of(result))
        return result

    def summarize(self, names: list[str] | None = None) -> DataFrame:
        return self._noted("summarize", {"names": names}, describe.summarize(self.df, names))

    def describe(self, names: list[str] | None = None) -> DataFrame:
        return frame.describe(self.df, names)

    def frequency(self, name: str) -> DataFrame:
        return describe.frequency(self.df, name)

    def histogram(self, name: str, bins: int = 24) -> DataFrame:
        return describe.histogram(self.df, name, bins)

    def scatter(self, x: str, y: str) -> DataFrame:
        return describe.scatter(self.df, x, y)

    def correlate(self, names: list[str] | None = None, spearman: bool = False) -> DataFrame:
        return self._noted("correlate", {"names": names, "spearman": spearman or None}, describe.correlate(self.df, names, spearman))

    def ttest_one(self, x: str, mean: float) -> DataFrame:
        return self._noted("ttest_one", {"x": x, "mean": mean}, hypothesis.ttest_one(self.df, x, mean))

    def ttest_by(self, x: str, group: str, welch: bool = False) -> DataFrame:
        return self._noted("ttest_by", {"x": x, "group": group, "welch": welch or None}, hypothesis.ttest_by(self.df, x, group, welch))

    def ttest_two(self, a: str, b: str) -> DataFrame:
        return self._noted("ttest_two", {"a": a, "b": b}, hypothesis.ttest_two(self.df, a, b))

    def ttest_paired(self, a: str, b: str) -> DataFrame:
        return self._noted("ttest_paired", {"a": a, "b": b}, hypothesis.ttest_paired(self.df, a, b))

    def anova(self, y: str, group: str) -> tuple[DataFrame, DataFrame]:
        table, groups = hypothesis.anova(self.df, y, group)
        return self._noted("anova", {"y": y, "group": group}, table), groups

    # Models

    def _store(self, command: str, arguments: dict[str, Any], fit: Fit, label: str | None) -> Fit:
        text = command_text(command, arguments)
        self.estimates.append(Estimate(f"M{len(self.estimates) + 1}", label or f"{fit.kind}: {fit.outcome}", text, fit))
        if self.project:
            self.project.append(text, result_of(fit))
        return fit

    def regress(self, y: str, x: list[str], label: str | None = None, diagnostics: bool = True, **options) -> Fit:
        """The fit; its ``checks`` are the diagnostics, which take three more passes and may be left out."""
        fit, design = linear.fitted(self.df, y, x, **options)
        if diagnostics:
            fit.checks = linear.diagnostics(design)
        return self._store("regress", {"y": y, "x": x, **options}, fit, label)

    def diagnostics(self, fit: Fit) -> DataFrame:
        return self.spark.createDataFrame(fit.checks, "check_name string, value double, verdict string")

    def xtreg(self, y: str, x: list[str], entity: str, model: str = "pooled", label: str | None = None, **options) -> Fit:
        models = {"fe": panel.fixed_effects, "be": panel.between, "pooled": panel.pooled}
        if model not in models:
            raise StatError("invalid_request", f"'{model}' is no panel model.", "Models are fe, be and pooled.", "Choose one.")
        return self._store("xtreg", {"y": y, "x": x, "entity": entity, "model": model, **options}, models[model](self.df, y, x, entity, **options), label)

    def ivregress(self, y: str, endogenous: list[str], instruments: list[str], exogenous: list[str] | None = None, label: str | None = None, **options) -> Fit:
        return self._store("ivregress", {"y": y, "endogenous": endogenous, "instruments": instruments, "exogenous": exogenous, **options}, panel.ivregress(self.df, y, endogenous, instruments, exogenous, **options), label)

    def did(self, y: str, treat: str, post: str, controls: list[str] | None = None, label: str | None = None, **options) -> Fit:
        return self._store("did", {"y": y, "treat": treat, "post": post, "controls": controls, **options}, panel.did(self.df, y, treat, post, controls, **options), label)

    def glm(self, family: str, y: str, x: list[str], label: str | None = None, **options) -> Fit:
        return self._store("glm", {"family": family, "y": y, "x": x, **options}, glm.glm(self.df, family, y, x, **options), label)

    # Estimates and notes

    def _selected(self, ids: tuple[str, ...]) -> list[Estimate]:
        known = {e.id.lower(): e for e in self.estimates}
        for i in ids:
            if i.lower() not in known:
                raise StatError("invalid_request", f"Estimate '{i}' was not found.", f"Stored: {', '.join(e.id for e in self.estimates) or 'none'}.", "See estimates_list.")
        chosen = [known[i.lower()] for i in ids] or self.estimates
        if not chosen:
            raise StatError("insufficient_data", "There are no estimates.", "No model has been fitted.", "Fit one first.")
        return chosen

    def estimates_list(self) -> DataFrame:
        rows = [(e.id, e.label, e.command, e.fit.kind, e.fit.n, fit_line(e.fit)) for e in self.estimates]
        return self.spark.createDataFrame(rows, "id string, label string, command string, kind string, n long, fit string")

    def compare(self, *ids: str) -> Comparison:
        chosen = self._selected(ids)
        cells = [{t: (float(b), float(s), float(p)) for t, b, s, p in zip(e.fit.terms, e.fit.coef, e.fit.se, e.fit.p)} for e in chosen]
        terms = list(dict.fromkeys(t for e in chosen for t in e.fit.terms))
        return Comparison([e.id for e in chosen], [e.label for e in chosen], terms, cells, [e.fit.n for e in chosen], [fit_line(e.fit) for e in chosen])

    def export_table(self, path: str, *ids: str) -> str:
        text = render_table(self.compare(*ids), path.rsplit(".", 1)[-1].lower())
        Path(path).write_text(text, encoding="utf-8")
        return text

    def export_data(self, path: str) -> None:
        csvio.export(self.df, path)

    def note(self, text: str) -> None:
        self.remarks.append(text)

    def notes(self) -> list[str]:
        return list(self.remarks)

    def help(self, command: str | None = None) -> str:
        if command is None:
            return "\n".join(f"{k}: {v}" for k, v in HELP.items())
        if command not in HELP:
            raise unknown_variable(command, list(HELP))
        return f"{command}: {HELP[command]}"


def column(value: Column | str | None) -> Column | None:
    return F.expr(value) if isinstance(value, str) else value


def expression_text(df: DataFrame, value: Column | str) -> str:
    """SQL text that gives the same plan as the expression does; what has none can't be recorded."""
    own = df.select(column(value).alias("value"))
    text = own._jdf.queryExecution().analyzed().expressions().head().child().sql()
    try:
        again = df.select(F.expr(text).alias("value"))
        same = own._jdf.queryExecution().optimizedPlan().canonicalized().equals(again._jdf.queryExecution().optimizedPlan().canonicalized())
    except AnalysisException:
        same = False
    if not same:
        raise StatError("invalid_request", "The expression can't be recorded.", f"Its text, {text}, doesn't read back as the same expression.", "Use functions of Spark SQL, or give the expression as text.")
    return text


def command_text(command: str, arguments: dict[str, Any]) -> str:
    given = {k: v for k, v in arguments.items() if v is not None and v != []}
    return json.dumps({"command": command, "arguments": given}, ensure_ascii=False, sort_keys=True)


def rows_of(result: DataFrame) -> dict[str, Any]:
    """A small result's rows, in their own order."""
    return {"columns": result.columns, "rows": [list(r) for r in result.collect()]}


def result_of(fit: Fit) -> dict[str, Any]:
    return {"kind": fit.kind, "n": fit.n, "terms": fit.terms, "coef": [float(x) for x in fit.coef], "se": [float(x) for x in fit.se], "p": [float(x) for x in fit.p], "figures": {k: float(v) for k, v in fit.figures.items()}}


def environment() -> dict[str, str]:
    import pyspark

    return {"python": platform.python_version(), "spark": pyspark.__version__, "system": platform.system(), "machine": platform.machine()}


#: Changes of the table that are recorded, and replayed.
CHANGES = {"generate", "replace", "drop_vars", "keep_vars", "drop_if", "keep_if", "rename", "label_variable", "sort"}


def state_after(state: str, change: str, arguments: dict[str, Any]) -> str:
    """Fingerprint of the table's recipe so far."""
    return hashlib.sha256(json.dumps([state, change, arguments], sort_keys=True).encode()).hexdigest()


@dataclass
class Project:
    """A folder on any file system that Spark reaches: project.json, datasets/ and registry/ (a file for each record, which nobody changes), data/ (Parquet), scripts/, notes/.

    Several sessions may add to one project at once. A session's changes of its
    table and its analyses are records; ``state`` is the fingerprint of the
    changes so far, and each analysis says in which state it ran.
    """

    store: Store
    about: dict[str, Any]
    state: str = ""

    @classmethod
    def create(cls, folder: str, name: str, data_uri: str | None = None) -> Project:
        """``folder`` without a scheme is the driver's own; ``data_uri`` is where Spark keeps the datasets then, which a cluster's executors must reach."""
        store = Store(SparkSession.active(), folder)
        if store.exists("project.json"):
            raise StatError("io", f"'{folder}' holds a project already.", "Projects don't share folders.", "Open it, or choose another folder.")
        out = cls(store, {"name": name, "data_uri": data_uri or f"{store.folder}/data", "environment": environment()})
        store.write("project.json", json.dumps(out.about, indent=1))
        return out

    @classmethod
    def open(cls, folder: str) -> Project:
        store = Store(SparkSession.active(), folder)
        if not store.exists("project.json"):
            raise StatError("io", f"'{folder}' can't be opened.", "It has no project.json.", "Check the folder.")
        return cls(store, json.loads(store.read("project.json")))

    def datasets(self) -> list[dict[str, Any]]:
        return self.store.records("datasets")

    def add_dataset(self, df: DataFrame, name: str) -> str:
        """The table as it is now; recipes begin from the last one added."""
        path = f"{self.about['data_uri']}/{uuid.uuid4().hex}.parquet"
        df.write.parquet(path)
        self.store.append("datasets", {"name": name, "path": path})
        self.state = ""
        return path

    def add_script(self, name: str, text: str) -> None:
        self.store.write("scripts/" + re.sub(r"[^\w.-]", "_", name), text)

    def add_note(self, text: str) -> str:
        n = len(self.store.names("notes")) + 1
        while self.store.exists(name := f"notes/note{n:03d}.md"):
            n += 1
        self.store.write(name, text)
        return name.removeprefix("notes/")

    def append(self, command: str, result: dict[str, Any]) -> None:
        """An analysis in the present state."""
        self.store.append("registry", json.loads(command) | {"result": result, "state": self.state})

    def append_change(self, change: str, arguments: dict[str, Any]) -> None:
        """A change of the table, which gives a new state."""
        given = {k: v for k, v in arguments.items() if v is not None}
        before, self.state = self.state, state_after(self.state, change, given)
        self.store.append("registry", {"change": change, "arguments": given, "before": before, "state": self.state})

    def records(self) -> list[dict[str, Any]]:
        return self.store.records("registry")

    def replay(self, spark: SparkSession, tolerance: float = 1e-9) -> DataFrame:
        """Run every record on the last dataset; a row for each, with its largest difference relative to max(1, |recorded|).

        Changes give the states that they are recorded to lead from and to;
        an analysis runs on the table of its own state. A state whose recipe is
        broken or was changed is told, for all that rest on it.
        """
        if not (known := self.datasets()):
            raise StatError("io", "There is no dataset to replay on.", "The project has none.", "Add one.")
        tables, rows = {"": Session(spark, spark.read.parquet(known[-1]["path"]))}, []
        for i, record in enumerate(self.records(), 1):
            name = record.get("change") or record.get("command", "")
            try:
                start = record.get("before" if "change" in record else "state", "")
                if start not in tables:
                    raise StatError("invalid_request", f"The table of '{name}' isn't known.", "Its recipe was changed, or a change of it failed.", "Check the records before.")
                session = Session(spark, tables[start].data, _order=list(tables[start]._order))
                if "change" in record:
                    if name not in CHANGES or state_after(start, name, record["arguments"]) != record["state"]:
                        raise StatError("invalid_request", f"'{name}' isn't as it was recorded.", "Its arguments don't have the fingerprint of its state.", "Check the registry.")
                    given = dict(record["arguments"])
                    getattr(session, name)(*given.pop("names", []), **given)
                    tables[record["state"]], worst = session, 0.0
                else:
                    if name not in RECORDED:
                        raise StatError("invalid_request", f"'{name}' can't be replayed.", "Only analyses and changes of the table are.", "Check the registry.")
                    options = {"diagnostics": False} if name == "regress" else {}
                    got = getattr(session, name)(**record["arguments"], **options)
                    again = result_of(got) if isinstance(got, Fit) else rows_of(got[0] if isinstance(got, tuple) else got)
                    worst = difference(record["result"], again)
                trouble = ""
            except (StatError, TypeError, KeyError, ValueError, AnalysisException) as e:  # one bad record doesn't end the replay
                worst, trouble = math.inf, str(e)
            rows.append((i, name, float(worst), bool(worst <= tolerance), trouble))
        return spark.createDataFrame(rows, "step int, command string, difference double, reproduced boolean, error string")


def difference(old: Any, new: Any) -> float:
    """The largest relative difference of numbers; infinite where the shapes or texts differ."""
    if isinstance(old, dict):
        if isinstance(new, dict) and new.keys() - old.keys():
            return math.inf
        return max((difference(v, new[k]) if isinstance(new, dict) and k in new else math.inf for k, v in old.items()), default=0.0)
    if isinstance(old, list):
        return max((difference(a, b) for a, b in zip(old, new)), default=0.0) if isinstance(new, list) and len(old) == len(new) else math.inf
    if isinstance(old, (int, float)) and isinstance(new, (int, float)):
        return 0.0 if old == new or (old != old and new != new) else abs(old - new) / max(1.0, abs(old))
    return 0.0 if old == new else math.inf
