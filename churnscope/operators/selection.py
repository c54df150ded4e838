"""Exact order statistics of any column without sorting the rows.

``select_ranks`` finds the rows at given ranks of an order (key ascending,
NULLs first; then id, where ids break ties).  It works in rounds, each of them
one aggregation over the rows:

1. A mergeable quantile sketch (KLL) of the keys of a span of the order, the
   whole order at first, gives splitters close below and above every wanted
   rank, and one at it.
2. The rows between the splitters, and those equal to a splitter, are counted,
   with the least and greatest key and id and a new sketch of each part.  The
   counts are exact, so they tell which part holds the rank, whatever the error
   of the sketch; that part is the next span.
3. A span of one key goes on with its ids: the six bytes after the longest
   common prefix of its least and greatest id, read as a number, are the key of
   the next rounds.  So ids may share any prefix.
4. A span of at most ``LIMIT`` rows is sorted in one task, which returns the
   rows at the wanted ranks.

The keys and ids are derived once and written to the shared checkpoint folder
for the time of the rounds, which read them from there.

A round leaves a few hundredths of a span, so the rounds grow with the
logarithm of the table, and no task sees more than sketches or ``LIMIT`` rows.
What reaches the driver is a row per part: wanted ranks times a few splitters.
The rounds run when a query is built, as a model is fitted; the result is
constants, so a query that uses them is a projection of its rows.

NaN counts as infinity.  Columns keep their native order, ids of whole numbers
too.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from churnscope.session import ensure_checkpoint_dir

LIMIT = 1 << 17  # rows of a span that one task may sort
MAX_GROUPS = 10_000
SKETCH_K = 1024
GRID = 256  # splitters are taken from so many steps of a sketch
REACH = 2  # steps to each side of a wanted rank; the sketch's error is below one
CHUNK = 6  # bytes of an id in one key


@dataclass(frozen=True)
class _Span:
    """Consecutive rows of one order."""

    name: str
    group: object
    key: tuple[float | None, float | None]  # least and greatest; NULL keys: None
    before: int  # rows ahead of it
    count: int
    ranks: tuple[int, ...]  # wanted, from 0
    ids: tuple[str, str] | None = None
    skip: int | None = None  # bytes that its ids share: keys are parts of ids
    splitters: tuple[float, ...] = field(default=())


def _sortable_id(df: DataFrame, id_col: str) -> Column:
    """A string that orders as the id does; NULL is the empty one."""
    if isinstance(df.schema[id_col].dataType, IntegralType):
        text = F.lpad((F.col(id_col).cast("decimal(20,0)") + F.lit(Decimal(1 << 63))).cast("string"), 20, "0")
    else:
        text = F.col(id_col).cast("string")
    return F.coalesce(F.concat(F.lit("\x01"), text), F.lit(""))


def id_number(ids: Column, skip: int) -> Column:
    """The next bytes of an id as a number that orders as they do; three more
    bits tell how many bytes there are."""
    raw = F.substring(F.encode(ids, "utf-8"), skip + 1, CHUNK)
    number = F.conv(F.rpad(F.hex(raw), 2 * CHUNK, "0"), 16, 10).cast("double")
    left = F.least(F.octet_length(ids) - skip, F.lit(CHUNK + 1))
    return number * 8 + F.greatest(left, F.lit(0))


def shared_bytes(a: str, b: str) -> int:
    x, y = a.encode(), b.encode()
    return next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))


def _number(x: float) -> Column:
    return F.lit(float(x))


def _inside(span: _Span, key: Column, ids: Column | None, group: Column | None) -> Column:
    low, high = span.key
    if low is None:
        found = key.isNull()
    else:
        found = (key >= _number(low)) & (key <= _number(high))
    if span.ids:
        found = found & (ids >= F.lit(span.ids[0])) & (ids <= F.lit(span.ids[1]))
    if group is not None:
        found = found & group.eqNullSafe(F.lit(span.group))
    return found


def _entries(rows: DataFrame, spans: list[_Span], keys: dict[str, Column], ids: Column | None, group: Column | None) -> DataFrame:
    """(part, x, key, id) of the rows inside a span; ``part`` numbers the parts
    between and at the span's splitters."""
    made = []
    for name, key in keys.items():
        part = x = None
        for number, span in enumerate(spans):
            if span.name != name:
                continue
            own = key if span.skip is None else id_number(ids, span.skip)
            place = F.lit(number << 16)
            for s in span.splitters:
                place = place + (own >= _number(s)).cast("int") + (own > _number(s)).cast("int")
            cond = _inside(span, key, ids, group)
            part = F.when(cond, place) if part is None else part.when(cond, place)
            x = F.when(cond, own) if x is None else x.when(cond, own)
        if part is not None:
            made.append(F.struct(part.alias("part"), x.alias("x"), key.alias("key"), (ids if ids is not None else F.lit("")).alias("id")))
    return rows.select(F.explode(F.array(*made)).alias("e")).select("e.*").where("part is not null")


def _parts(entries: DataFrame, *by: str) -> list:
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    sketch = F.kll_sketch_agg_double("x", F.lit(SKETCH_K))
    return (
        entries.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"),
            F.min("id").alias("first_id"), F.max("id").alias("last_id"), sketch.alias("sketch"),
        )
        .withColumn("grid", F.when(F.col("least") < F.col("most"), F.kll_sketch_get_quantile_double("sketch", grid)))
        .drop("sketch")
        .collect()
    )


def _splitters(grid: list[float], span: _Span) -> tuple[float, ...]:
    """Values of the sketch around the wanted ranks of a span."""
    out = set()
    for rank in span.ranks:
        step = int((rank - span.before) / max(1, span.count - 1) * GRID)
        out |= {grid[min(max(step + d, 0), GRID)] for d in (-REACH, 0, 1, REACH + 1)}
    return tuple(sorted(x for x in out if not math.isnan(x)))


def select_ranks(
    df: DataFrame, keys: dict[str, Column], wanted: Callable[[int], list[int]], id_col: str | None = None, group: str | None = None,
    nulls: bool = True,
) -> dict[tuple[object, str], tuple[int, dict[int, tuple[float | None, str]]]]:
    """For each (group, order name): the number of rows, and for each rank of
    ``wanted(rows)`` the (key, sortable id) of the row there.  Without
    ``nulls``, rows whose key is NULL are not in the order."""
    raw = {name: key.cast("double") for name, key in keys.items()}
    # -0.0 and 0.0 are one key
    source = df.select(
        *[(F.when(F.isnan(k), F.lit(math.inf)).otherwise(k) + F.lit(0.0)).alias(f"k{i}") for i, k in enumerate(raw.values())],
        *([_sortable_id(df, id_col).alias("id")] if id_col else []), *([F.col(group).alias("g")] if group else []),
    )
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/churnscope-ranks-{uuid.uuid4().hex}"
    try:
        source.write.parquet(path)
        return _rounds(spark.read.schema(source.schema).parquet(path), list(raw), wanted, bool(id_col), bool(group), nulls)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _rounds(source: DataFrame, names: list[str], wanted: Callable[[int], list[int]], id_col: bool, group: bool, nulls: bool) -> dict:
    """``select_ranks`` over keys ``k0``..., ``id`` and ``g``."""
    keyed = {name: F.col(f"k{i}") for i, name in enumerate(names)}
    ids, by = F.col("id") if id_col else None, F.col("g") if group else None

    structs = [
        F.struct(F.lit(i).alias("name"), (by if group else F.lit(0)).alias("g"), k.isNull().alias("absent"), k.alias("x"), (ids if id_col else F.lit("")).alias("id"))
        for i, k in enumerate(keyed.values())
    ]
    first = source.select(F.explode(F.array(*structs)).alias("e")).select("e.*")
    first = _parts(first if nulls else first.where("not absent"), "name", "g", "absent")
    if len({r.g for r in first}) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups; order statistics are for groups by label")

    out: dict = {}
    active: list[tuple[_Span, object]] = []
    for r in sorted(first, key=lambda r: not r.absent):  # NULL keys come first
        name = names[r.name]
        size, found = out.get((r.g, name), (0, {}))
        out[r.g, name] = (size + r.n, found)
        active.append((_Span(name, r.g, (r.least, r.most), 0 if r.absent else size, r.n, ()), r))
    ranks = {key: sorted({k for k in wanted(size) if 0 <= k < size}) for key, (size, _) in out.items()}
    active = [(replace(s, ranks=tuple(k for k in ranks[s.group, s.name] if s.before <= k < s.before + s.count)), r) for s, r in active]
    small: list[_Span] = []
    while True:
        spans: list[_Span] = []
        for span, r in active:
            if not span.ranks:
                continue
            single = span.skip is None and span.key[0] == span.key[1]
            if single and (not id_col or r.first_id == r.last_id) or span.skip is not None and r.first_id == r.last_id:
                out[span.group, span.name][1].update({k: (span.key[0], r.first_id) for k in span.ranks})
            elif span.count <= LIMIT:
                small.append(span)
            elif single or (span.skip is not None and r.least == r.most):
                spans.append(replace(span, ids=(r.first_id, r.last_id), skip=shared_bytes(r.first_id, r.last_id), splitters=()))
            else:
                spans.append(replace(span, splitters=_splitters(r.grid, span)))
        if not spans:
            break
        active = []
        for r in sorted(_parts(_entries(source, spans, keyed, ids, by), "part"), key=lambda r: r.part):
            span = spans[r.part >> 16]
            before = span.before + sum(s.count for s, q in active if q.part >> 16 == r.part >> 16)
            key = (r.least, r.most) if span.skip is None else span.key
            own = tuple(k for k in span.ranks if before <= k < before + r.n)
            active.append((replace(span, key=key, before=before, count=r.n, ranks=own, ids=(r.first_id, r.last_id) if id_col and span.skip is not None else None, splitters=()), r))
    if small:
        lists = _entries(source, [replace(s, splitters=()) for s in small], keyed, ids, by).groupBy("part").agg(
            F.sort_array(F.collect_list(F.struct("key", "id"))).alias("rows")
        )
        places = F.map_from_arrays(
            F.array(*[F.lit(i << 16) for i in range(len(small))]),
            F.array(*[F.array(*[F.lit(k - s.before + 1) for k in s.ranks]) for s in small]),
        )
        picked = lists.select("part", F.transform(F.element_at(places, F.col("part")), lambda at: F.element_at("rows", at)).alias("rows"))
        for r in picked.collect():
            span = small[r.part >> 16]
            out[span.group, span.name][1].update({k: (row.key, row.id) for k, row in zip(span.ranks, r.rows)})
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float], group: str | None = None) -> DataFrame:
    """Exact quantiles (linear interpolation) of each column, NULLs left out:
    rows (group, name, p, value), found when called."""
    found = quantile_values(df, cols, probs, group)
    kind = df.schema[group].dataType if group else "int"
    rows = [
        F.struct(F.lit(g).cast(kind).alias(group or "g"), F.lit(name).alias("name"), F.lit(p).alias("p"), F.lit(value).alias("value"))
        for (g, name, p), value in (found or {(None, "", 0.0): 0.0}).items()
    ]
    out = df.sparkSession.range(1 if found else 0).select(F.inline(F.array(*rows)))
    return out.select(*([group] if group else []), "name", "p", "value")


def quantile_values(df: DataFrame, cols: list[str], probs: list[float], group: str | None = None) -> dict[tuple[object, str, float], float]:
    """(group, column, p) -> exact quantile."""

    def ranks(n: int) -> list[int]:
        return [f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)]

    out = {}
    for (g, name), (n, rows) in select_ranks(df, {c: F.col(c) for c in cols}, ranks, group=group, nulls=False).items():
        for p in probs:
            at = p * (n - 1)
            low, high = rows[math.floor(at)][0], rows[math.ceil(at)][0]
            share = at - math.floor(at)
            out[g, name, float(p)] = low if low == high else low * (1 - share) + high * share
    return out


def ntile_columns(df: DataFrame, orders: dict[str, Column], id_col: str, buckets: int) -> dict[str, Column]:
    """For each (name, numeric key): a column with the NTILE bucket of the row
    in the order (key ascending, NULLs first; id), as the window function gives.

    The last row of every bucket but the final one is selected exactly; a row's
    bucket is one plus the number of those edges that lie before it: comparisons
    with ``buckets - 1`` constants, no sort and no join of the rows."""

    def ends(n: int) -> list[int]:
        return [j * (n // buckets) + min(j, n % buckets) - 1 for j in range(1, buckets)]

    found = select_ranks(df, orders, ends, id_col) if orders else {}
    ids = _sortable_id(df, id_col)

    def bucket(name: str, key: Column) -> Column:
        key, out = key.cast("double"), F.lit(1)
        key = F.when(F.isnan(key), F.lit(math.inf)).otherwise(key)
        size, rows = found.get((0, name), (0, {}))
        for rank in ends(size):
            if rank not in rows:
                continue
            value, edge = rows[rank]
            if value is None:
                after = key.isNotNull() | (ids > F.lit(edge))
            else:
                after = F.coalesce((key > _number(value)) | ((key == _number(value)) & (ids > F.lit(edge))), F.lit(False))
            out = out + after.cast("int")
        return out

    return {name: bucket(name, key) for name, key in orders.items()}
