"""Schemas that drift between the files of a source.

Method: tagged-union inference. Every file's lines are reduced, map side, to the set of
(path, type tag) pairs they hold; fusing those sets keeps all alternative types of a path instead of
widening them away. Consecutive files are compared by equi-joins of these small sets, renames are
proven by equal values in the records two files share, and the lineage that follows links every
spelling of a field to the name it began with. `consistent_facts` then reads all files into one
table with a typed branch for each alternative and a canonical conversion.

Lines are parsed by Arrow batches in Python, as JSON text has to be judged whole: the JVM's reader
takes a line with rubbish behind the closing brace, refuses repeated keys and loses the written form of numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finstrata.functions.exprs import european_number
from finstrata.operators.ordered import neighbours
from finstrata.session import cut_lineage, share_code

RECORD_KEY = ("local_path", "statement", "adp_code", "column_name")
TYPES = ("string", "integer", "decimal", "boolean", "array")
#: Parts of a record key are joined by this; it can't stand in JSON text unescaped.
SEP = "\x1f"


class _Number(str):
    """A JSON number in its written form."""


class _Int(_Number):
    pass


class _Decimal(_Number):
    pass


def _no_constant(name: str) -> None:
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_int=_Int, parse_float=_Decimal, parse_constant=_no_constant)


def _plain(v: object) -> object:
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return int(v) if isinstance(v, _Int) else float(v) if isinstance(v, _Decimal) else v


def flatten(line: str | None) -> dict[str, tuple[str | None, str | None]] | None:
    """path -> (type, value as text) of a line that is a whole JSON object, else None. Nulls have neither.

    An empty object holds no field. Of two values at one path the last counts.
    """
    if not line:
        return None
    try:
        top = _decoder.decode(line)
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    out: dict[str, tuple[str | None, str | None]] = {}
    stack = [("", top)]
    while stack:
        at, obj = stack.pop()
        for k, v in obj.items():
            path = f"{at}.{k}" if at else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is None:
                out[path] = (None, None)
            elif isinstance(v, bool):
                out[path] = ("boolean", "true" if v else "false")
            elif isinstance(v, _Int):
                out[path] = ("integer", str(v))
            elif isinstance(v, _Decimal):
                out[path] = ("decimal", str(v))
            elif isinstance(v, list):
                out[path] = ("array", json.dumps(_plain(v), ensure_ascii=False))
            else:
                out[path] = ("string", v)
    return out


def _safe(text: str | None) -> str | None:
    """Lone surrogates, which JSON can name but UTF-8 can't hold, as a question mark."""
    return None if text is None else text.encode("utf-8", "replace").decode("utf-8")


def record_key(flat: dict) -> str:
    return SEP.join((flat.get(k) or (None, None))[1] or "" for k in RECORD_KEY)


def _schemas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = set()
        for f, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            flat = flatten(line)
            if flat is not None:
                found.update((f, p, t or "") for p, (t, _) in flat.items())
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([_safe(r[1]) for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["fkey", "path", "type"])


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        f_, p_, r_, v_ = [], [], [], []
        for f, line, paths in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            flat = flatten(line)
            if flat is None:
                continue
            key = record_key(flat)
            for p in paths:
                got = flat.get(p)
                f_.append(f)
                p_.append(p)
                r_.append(_safe(key))
                v_.append(_safe(got[1]) if got else None)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (f_, p_, r_, v_)], names=["fkey", "path", "record", "text"])


def _keyed(landing: DataFrame) -> DataFrame:
    """Files are named by source and file_id; a null of either is a name of its own."""
    return landing.withColumn("fkey", F.concat_ws(SEP, F.coalesce(F.col("source"), F.lit("\x00")), F.coalesce(F.col("file_id").cast("string"), F.lit("\x00"))))


def file_order(landing: DataFrame) -> DataFrame:
    """(fkey, source, file_id, produced_at, prev_fkey): each file with the file of its source produced before it.

    Files of one source that were produced at the same time follow by file_id.
    """
    files = _keyed(landing).groupBy("fkey", "source", "file_id").agg(F.min("produced_at").alias("produced_at"))
    return neighbours(files, ["source"], ["produced_at", "file_id"], F.date_trunc("day", "produced_at"), ["fkey"])


def file_schemas(landing: DataFrame) -> DataFrame:
    """(fkey, path, types): the tagged union of each path of each file, types sorted, without those of nulls."""
    lines = _keyed(landing).select("fkey", "payload")
    tags = lines.mapInArrow(_schemas, "fkey string, path string, type string")
    return tags.groupBy("fkey", "path").agg(F.array_sort(F.array_remove(F.collect_set("type"), "")).alias("types"))


def _renames(landing: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    """(fkey, prev_fkey, path, old_path) of the new paths whose values are those of a path that is gone.

    Both files' shared records must agree on every value either of them states, at least on one. If
    several pairs would do, the one with most records wins, then the first names; each name is used once.
    """
    both = gone.select("fkey").distinct().join(new.select("fkey").distinct(), "fkey")
    gone, new = gone.join(both, "fkey", "left_semi"), new.join(both, "fkey", "left_semi")
    # the lines of a file are asked for new paths of its own and for paths gone in the next file
    wanted = gone.select(F.col("prev_fkey").alias("fkey"), "path").unionByName(new.select("fkey", "path")).groupBy("fkey").agg(F.collect_set("path").alias("paths"))
    lines = _keyed(landing).select("fkey", "payload").join(wanted, "fkey").select("fkey", "payload", "paths")
    values = cut_lineage(lines.mapInArrow(_values, "fkey string, path string, record string, text string").groupBy("fkey", "path", "record").agg(F.max("text").alias("text")))
    old = values.join(gone.select(F.col("prev_fkey").alias("fkey"), "path", F.col("fkey").alias("at")), ["fkey", "path"]).select("at", F.col("path").alias("old_path"), "record", F.col("text"))
    now = values.join(new.select("fkey", "path"), ["fkey", "path"]).select(F.col("fkey").alias("at"), "path", "record", "text")
    # records that both files hold
    shared = old.select("at", "record").distinct().join(now.select("at", "record").distinct(), ["at", "record"])
    old = old.join(shared, ["at", "record"], "left_semi").filter("text IS NOT NULL")
    now = now.join(shared, ["at", "record"], "left_semi").filter("text IS NOT NULL")
    hits = old.join(now, ["at", "record", "text"]).groupBy("at", "old_path", "path").agg(F.count(F.lit(1)).alias("n"))
    n_old = old.groupBy("at", "old_path").agg(F.count(F.lit(1)).alias("n_old"))
    n_now = now.groupBy("at", "path").agg(F.count(F.lit(1)).alias("n_now"))
    full = hits.join(n_old, ["at", "old_path"]).join(n_now, ["at", "path"]).filter("n = n_old AND n = n_now")
    ones = full.groupBy("at").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "old_path", "path"))).alias("pairs"))
    # greedy one-to-one over the few candidate pairs of a file
    pick = F.aggregate(
        "pairs", F.expr("cast(array() as array<struct<m:bigint,old_path:string,path:string>>)"),
        lambda done, x: F.when(F.exists(done, lambda y: (y.old_path == x.old_path) | (y.path == x.path)), done).otherwise(F.concat(done, F.array(x))),
    )
    return ones.select(F.col("at").alias("fkey"), F.inline(pick)).select("fkey", "path", "old_path")


class Drift:
    """The schemas of all files and how each came from the one before; build with `drift(landing)`."""

    def __init__(self, files: DataFrame, nodes: DataFrame, renames: DataFrame, state: DataFrame, gone: DataFrame):
        self.files, self.nodes, self.renames, self.state, self.gone = files, nodes, renames, state, gone

    def changes(self) -> DataFrame:
        """(file_id, source, change_kind, field_name, old_name, types, old_types), one row per change.

        added, removed, renamed and retyped as TESTDATA.md defines them; a field with several types in
        one file is compared as the set of them. A source's first file has no changes.
        """
        ids = self.files.select("fkey", "file_id", "source")
        s = self.state
        none = F.lit(None).cast("string")
        no_types = F.lit(None).cast("array<string>")
        added = s.filter("prev_fkey IS NOT NULL AND origin = 'added'").select("fkey", F.lit("added").alias("change_kind"), F.col("path").alias("field_name"), none.alias("old_name"), "types", no_types.alias("old_types"))
        renamed = s.filter("origin = 'renamed'").select("fkey", F.lit("renamed").alias("change_kind"), F.col("path").alias("field_name"), F.col("old_path").alias("old_name"), "types", F.col("before").alias("old_types"))
        retyped = s.filter("size(types) > 0 AND before IS NOT NULL AND types <> before").select("fkey", F.lit("retyped").alias("change_kind"), F.col("path").alias("field_name"), F.col("old_path").alias("old_name"), "types", F.col("before").alias("old_types"))
        taken = self.renames.select("fkey", F.col("old_path").alias("path"))
        removed = self.gone.join(taken, ["fkey", "path"], "left_anti").select("fkey", F.lit("removed").alias("change_kind"), F.col("path").alias("field_name"), none.alias("old_name"), no_types.alias("types"), no_types.alias("old_types"))
        rows = added.unionByName(renamed).unionByName(retyped).unionByName(removed)
        return rows.join(ids, "fkey").select("file_id", "source", "change_kind", "field_name", "old_name", "types", "old_types")


def drift(landing: DataFrame) -> Drift:
    """Compare every file of `landing` with the one of its source before it.

    `landing` has source, file_id, produced_at and payload; other columns are ignored. Null and damaged
    payloads don't count; a file with nothing else has no fields. Files sent twice under one file_id are one
    file. An empty table gives empty results.
    """
    files = cut_lineage(file_order(share_code(landing)))
    link = files.select("fkey", "source", "produced_at", "file_id", "prev_fkey")
    nodes = cut_lineage(file_schemas(landing))
    here = nodes.join(link, "fkey")
    before = nodes.select(F.col("fkey").alias("prev_fkey"), "path", F.lit(True).alias("was"))
    here = here.join(before, ["prev_fkey", "path"], "left").select("fkey", "prev_fkey", "source", "produced_at", "file_id", "path", "types", F.coalesce("was", F.lit(False)).alias("was"))
    here = cut_lineage(here)
    new = here.filter("prev_fkey IS NOT NULL AND NOT was").select("fkey", "prev_fkey", "path")
    follow = link.filter("prev_fkey IS NOT NULL").select(F.col("fkey").alias("at"), F.col("prev_fkey").alias("fkey"))
    held = nodes.select("fkey", "path").join(follow, "fkey").select(F.col("at").alias("fkey"), F.col("fkey").alias("prev_fkey"), "path")
    gone = cut_lineage(held.join(nodes.select("fkey", "path"), ["fkey", "path"], "left_anti"))
    renames = cut_lineage(_renames(landing, gone, new))

    # a run is a stretch of files that hold a path without a break; `start` marks its first file
    here = here.join(renames, ["fkey", "path"], "left").withColumn(
        "origin", F.when(F.col("was"), "stayed").when(F.col("old_path").isNotNull(), "renamed").otherwise("added")
    )
    order = ["produced_at", "file_id"]
    pos = F.struct(*order)
    here = here.withColumn("start", F.when(F.col("origin") != "stayed", F.struct(pos.alias("pos"), "fkey"))).withColumn("typed", F.when(F.size("types") > 0, F.struct(pos.alias("pos"), "types")))
    seen = neighbours(here, ["source", "path"], order, F.date_trunc("day", "produced_at"), ["start", "typed"])
    run = F.coalesce("start", "prev_start")
    seen = seen.withColumn("run", run).withColumn("own", F.when(F.col("prev_typed.pos") >= F.col("run.pos"), F.col("prev_typed.types")))
    seen = cut_lineage(seen)

    # what a run that began by a rename takes over from the run it continues: the types the old name had
    # in the file before. Where that run stated none either, go on to the run that one continues.
    ends = seen.select(F.col("fkey").alias("p_fkey"), F.col("path").alias("p_path"), F.coalesce(F.when(F.size("types") > 0, F.col("types")), F.col("own")).alias("p_types"), F.col("run.fkey").alias("p_run"))
    starts = seen.filter("origin = 'renamed'").select("fkey", "path", "prev_fkey", "old_path")
    heads = starts.join(ends, (F.col("prev_fkey") == F.col("p_fkey")) & (F.col("old_path") == F.col("p_path"))).select("fkey", "path", F.col("p_types").alias("taken"), F.col("p_run").alias("up_fkey"), F.col("p_path").alias("up_path"), F.col("p_path").alias("root_hint"))
    heads = cut_lineage(heads)
    while True:
        up = heads.select(F.col("fkey").alias("up_fkey"), F.col("path").alias("up_path"), F.col("taken").alias("u_taken"), F.col("up_fkey").alias("u_fkey"), F.col("up_path").alias("u_path"))
        open_ = heads.filter("taken IS NULL").join(up, ["up_fkey", "up_path"], "left_semi").limit(1).count()
        if not open_:
            break
        stepped = heads.join(up, ["up_fkey", "up_path"], "left")
        more = F.col("taken").isNull() & F.col("u_fkey").isNotNull()
        heads = cut_lineage(stepped.select(
            "fkey", "path", F.when(more, F.col("u_taken")).otherwise(F.col("taken")).alias("taken"),
            F.when(more, F.col("u_fkey")).otherwise(F.col("up_fkey")).alias("up_fkey"),
            F.when(more, F.col("u_path")).otherwise(F.col("up_path")).alias("up_path"), "root_hint",
        ))
    taken = heads.select(F.col("fkey").alias("run_fkey"), "path", "taken")
    state = seen.withColumn("run_fkey", F.col("run.fkey")).join(taken, ["run_fkey", "path"], "left").withColumn("before", F.coalesce("own", "taken"))
    return Drift(files, nodes, renames, cut_lineage(state.drop("start", "typed", "prev_start", "prev_typed", "run")), gone)


def canonical_names(d: Drift, aliases: dict[str, str] | None = None) -> DataFrame:
    """(fkey, path, field): the name a path's lineage began with, or what `aliases` say of its first name that they know.

    Known are the names they lead from and to and the record's key. Renames are followed from link to link,
    doubling the distance each round.
    """
    runs = d.state.filter("origin <> 'stayed'").select(F.col("fkey").alias("run_fkey"), "path", "prev_fkey", "old_path")
    at = d.state.select(F.col("fkey").alias("prev_fkey"), F.col("path").alias("old_path"), F.col("run_fkey").alias("up_fkey"))
    links = cut_lineage(runs.join(at, ["prev_fkey", "old_path"], "left").select("run_fkey", "path", F.when(F.col("up_fkey").isNotNull(), F.col("old_path")).alias("up_path"), "up_fkey"))
    links = links.withColumn("field", F.coalesce("up_path", "path")).withColumn("root", F.coalesce("up_fkey", "run_fkey"))
    while links.filter("up_fkey IS NOT NULL").limit(1).count():
        up = links.select(F.col("run_fkey").alias("up_fkey"), F.col("path").alias("up_path"), F.col("up_fkey").alias("u_fkey"), F.col("up_path").alias("u_path"), F.col("field").alias("u_field"), F.col("root").alias("u_root"))
        links = cut_lineage(links.join(up, ["up_fkey", "up_path"], "left").select("run_fkey", "path", F.col("u_path").alias("up_path"), F.col("u_fkey").alias("up_fkey"), F.coalesce("u_field", "field").alias("field"), F.coalesce("u_root", "root").alias("root")))
    named = links.select("run_fkey", "path", "field", "root")
    if aliases:
        known = F.create_map(*[F.lit(x) for kv in ({k: k for k in (*RECORD_KEY, *aliases.values())} | aliases).items() for x in kv])
        said = named.join(d.files.select(F.col("fkey").alias("run_fkey"), "produced_at", "file_id"), "run_fkey").withColumn("known", F.try_element_at(known, "path"))
        said = said.filter("known IS NOT NULL").groupBy("root", "field").agg(F.min_by("known", F.struct("produced_at", "file_id")).alias("known"))
        named = named.join(said, ["root", "field"], "left").withColumn("field", F.coalesce("known", "field"))
    return d.state.select("fkey", "path", "run_fkey").join(named, ["run_fkey", "path"]).select("fkey", "path", "field")


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols: list[list] = [[] for _ in range(6)]
        for f, n, line in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            flat = flatten(line)
            if flat is None:
                continue
            key = _safe(record_key(flat))
            for p, (t, v) in flat.items():
                for c, x in zip(cols, (f, n, key, _safe(p), t, _safe(v)), strict=True):
                    c.append(x)
        kinds = [pa.string(), pa.int32(), *[pa.string()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["fkey", "line_no", "record", "path", "type", "text"])


#: The names under which sources send the fields of a fact.
FACT_ALIASES = {
    "sheet_name": "source_sheet", "sheet": "source_sheet", "worksheet": "source_sheet", "list_obrasca": "source_sheet", "source.sheet": "source_sheet",
    "sourceSheet": "source_sheet", "SOURCE_SHEET": "source_sheet", "Source_Sheet": "source_sheet",
    "row": "source_row", "row_no": "source_row", "redak": "source_row", "rbr": "source_row", "source.row": "source_row", "sourceRow": "source_row", "SOURCE_ROW": "source_row",
    "Label": "label", "naziv": "label", "pozicija": "label", "caption.text": "label", "item_text": "label", "opis_pozicije": "label", "lineLabel": "label",
    "measure": "unit", "valuta": "unit", "currency": "unit", "reported.unit": "unit", "iznos": "value", "amount": "value", "val": "value", "reported.value": "value",
}
_KEY_FIELDS = (*RECORD_KEY,)


def _whole_text(branch: Column) -> Column:
    """The text of a branch; an array's elements follow each other with a blank between, without nulls. An empty array states nothing."""
    words = F.nullif(F.array_join(F.from_json(branch["text"], "array<string>"), " "), F.lit(""))
    return F.when(branch["type"] == "array", words).otherwise(branch["text"])


def _amount(branch: Column) -> Column:
    """The number a branch states: numbers as they are, texts also in European form (`1.234,5`) or with an exponent. An array must hold one element; null for anything else."""
    one = F.when(F.size(F.from_json(branch["text"], "array<string>")) == 1, F.get_json_object(branch["text"], "$[0]"))
    text = F.when(branch["type"] == "array", one).otherwise(branch["text"])
    plain = F.trim(text)
    read = F.coalesce(
        european_number(text), F.when(plain.rlike(r"^[-+]?\d{1,3}(?:\.\d{3}){2,}$"), F.replace(plain, F.lit("."), F.lit("")).try_cast("double")),
        F.when(plain.rlike(r"^[-+]?(?:\d+\.?\d*|\.\d+)[eE][-+]?\d+$"), plain.try_cast("double")),
    )
    return F.when(branch["type"].isin("integer", "decimal"), text.try_cast("double")).when(branch["type"].isin("string", "array"), read)


def consistent_facts(landing: DataFrame, d: Drift | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """One row per whole line of `landing`, in one schema however its file spelled and typed it.

    local_path, statement, adp_code, column_name, source_sheet, label, unit as text and integer, source_row
    and value converted (`R119`, `119` and `[119, 119]` all give row 119; a text sent as a list of words is
    all of them with a blank between; `188.578,29` is the value 188578.29); `branches` holds, per canonical field,
    the value as written and the type it had, so what doesn't convert isn't lost; `extras` likewise the other fields, and
    under their own names those of a line in which another spelling of the same field counts.
    """
    d = d or drift(landing)
    names = canonical_names(d, FACT_ALIASES if aliases is None else aliases)
    long = _keyed(landing).select("fkey", "line_no", "payload").mapInArrow(_branches, "fkey string, line_no int, record string, path string, type string, text string")
    long = long.join(names, ["fkey", "path"], "left").withColumn("field", F.coalesce("field", "path"))
    one = long.groupBy("fkey", "line_no", "record", "field").agg(F.sort_array(F.collect_set(F.struct(F.col("text").isNotNull().alias("some"), "path", F.struct("type", "text").alias("b"))), asc=False).alias("all"))
    # the first of each path; only the first of all is the field
    apart = F.aggregate("all", F.expr("cast(array() as array<struct<some:boolean,path:string,b:struct<type:string,text:string>>>)"), lambda done, x: F.when(F.exists(done, lambda y: y.path == x.path), done).otherwise(F.concat(done, F.array(x))))
    one = one.withColumn("all", F.when(F.size("all") > 1, apart).otherwise(F.col("all")))
    rows = one.groupBy("fkey", "line_no", "record").agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.col("all")[0]["b"].alias("b")))).alias("branches"),
        F.flatten(F.collect_list(F.transform(F.slice("all", 2, F.greatest(F.size("all"), F.lit(1))), lambda x: F.struct(x.path.alias("path"), F.col("field").alias("field"), x.b.alias("b"))))).alias("more"),
    )
    name = lambda x: F.when(F.map_contains_key("branches", x.path), F.concat_ws(SEP, x.path, x.field)).otherwise(x.path)
    more = F.map_from_entries(F.transform("more", lambda x: F.struct(name(x), x.b)))
    of = lambda f: F.try_element_at("branches", F.lit(f))
    first = lambda f: F.when(of(f)["type"] == "array", F.get_json_object(of(f)["text"], "$[0]")).otherwise(of(f)["text"])
    own = (*_KEY_FIELDS, "source_sheet", "source_row", "label", "unit", "value")
    return rows.join(d.files.select("fkey", "file_id", "source", "produced_at"), "fkey").select(
        "file_id", "source", "produced_at", "line_no",
        *[_whole_text(of(f)).alias(f) for f in ("local_path", "statement", "column_name", "source_sheet", "label", "unit")],
        first("adp_code").try_cast("int").alias("adp_code"),
        F.regexp_extract(F.coalesce(first("source_row"), F.lit("")), r"(\d+)", 1).try_cast("int").alias("source_row"),
        _amount(of("value")).alias("value"),
        F.map_filter("branches", lambda k, _: k.isin(*own)).alias("branches"),
        F.map_concat(F.map_filter("branches", lambda k, _: ~k.isin(*own)), more).alias("extras"),
    )
