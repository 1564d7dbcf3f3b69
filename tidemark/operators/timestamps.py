"""Problem 1: texts of mixed formats, precisions and zones to UTC instants.

Every text gets the array of all its valid interpretations (built by JVM
expressions only): both orders of day and month, both instants of a clock time that a
clock change repeats, all zones that use an abbreviation. None is dropped beforehand. What
is known of a source only weighs: an interpretation against the order its feed declares, or by a
less common zone of an abbreviation, costs something. A Viterbi search over the record order
of each source chooses, at a further cost for each change of format and for each step back in time.

A row with one interpretation cuts the search in two, so only rows with several, their
direct neighbours and the ends of blocks enter Python, where all stretches between such rows are searched at
once, array by array. A block is ``order div block_rows`` and so has a bounded
size however hot its source is. Blocks are joined exactly: each gives the
cheapest cost from each interpretation of its first row to each of its last
row, a pass over these summaries (one row a block) fixes both ends, and a last
pass traces back inside each block.
"""

from __future__ import annotations

import zoneinfo

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import materialize

#: Minutes east of UTC of zone abbreviations; where several zones use one, all are listed, the commonest first. Fixed values.
ABBREVIATIONS = {
    "Z": (0,), "UTC": (0,), "GMT": (0,), "WET": (0,), "WEST": (60,), "BST": (60,), "CET": (60,), "CEST": (120,),
    "EET": (120,), "EEST": (180,), "MSK": (180,), "EST": (-300,), "EDT": (-240,), "CST": (-360, 480), "CDT": (-300,),
    "MST": (-420,), "MDT": (-360,), "PST": (-480,), "PDT": (-420,), "NST": (-210,), "NDT": (-150,), "AST": (-240, 180),
    "ADT": (-180,), "IST": (330, 60, 120), "NPT": (345,), "JST": (540,), "KST": (540,), "HKT": (480,), "SGT": (480,),
    "AEST": (600,), "AEDT": (660,), "ACST": (570,), "ACDT": (630,), "AWST": (480,), "NZST": (720,), "NZDT": (780,),
}
#: Month by the first three letters of its English, German, Spanish, Portuguese or Italian name. Fixed values.
MONTHS = {
    1: "jan ene gen jän", 2: "feb fev", 3: "mar mär mrz", 4: "apr abr", 5: "may mai mag", 6: "jun giu", 7: "jul lug", 8: "aug ago",
    9: "sep set", 10: "oct okt out ott", 11: "nov", 12: "dec dez dic",
}
#: Instants outside 1990 to 2100 are no plausible reading of a bare number (seconds).
FIRST_S, LAST_S = 631_152_000, 4_102_444_800
#: Format numbers in the result.
FORMATS = {"epoch_s": 1, "epoch_ms": 2, "epoch_us": 3, "epoch_ns": 4, "iso": 5, "dmy": 6, "mdy": 7, "dot": 8, "compact": 9, "named": 10, "us": 11, "date": 12}
#: Viterbi costs: of a change of format, of a step back in time, of a less common zone of an abbreviation, and of the order of
#: day and month that a feed doesn't declare (more than one late row can save by it: twice SWITCH and twice BACK).
SWITCH, BACK, RARER, UNDECLARED = 1.0, 2.0, 2.0, 8.0
MOST = 6  # interpretations that a text can have: two orders by three zones
PLAIN, REPEATED, SKIPPED = 0, 1, 2  # kinds of a clock time under its zone's clock changes

_CLOCK = r"(\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?)"
_PATTERNS = {
    "iso": r"^(\d{4}-\d{2}-\d{2})[Tt ]" + _CLOCK,
    "slash": r"^(\d{1,2})/(\d{1,2})/(\d{4})[ T]" + _CLOCK,
    "dot": r"^(\d{1,2})\.(\d{1,2})\.(\d{4})[ T]" + _CLOCK,
    "compact": r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})(?=\D|$)",
    "named": r"^(?:\p{L}{2,9},? )?(\d{1,2})[ .-]{1,2}(\p{L}{3})\p{L}*\.?[ -](\d{4}) " + _CLOCK,
    "us": r"^(\p{L}{3})\p{L}*\.? (\d{1,2}),? (\d{4}),? (\d{1,2})(:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?) ?([AaPp])\.?[Mm]\.?",
    "date": r"^(\d{4})-(\d{2})-(\d{2})$",
}
_CANDS = "array<struct<us:bigint,fmt:int,cost:double,kind:int>>"
_NONE = f"cast(array() as {_CANDS})"


def _q(s: str) -> str:
    return "r'" + s + "'"


def with_interpretations(df: DataFrame, text: str, zone: str, order: str, out: str, span: tuple[int, int] = (FIRST_S, LAST_S)) -> DataFrame:
    """Add ``out``: every valid interpretation of ``text`` as array of (us, fmt, cost, kind).

    ``zone`` holds the IANA zone of texts that name none (null: UTC), ``order`` DMY
    or MDY, the order that the source declares (null: none): the other one is kept at a cost. A clock time that
    a clock change repeats has two interpretations; one that it skips has one of kind SKIPPED, which denotes no instant. ``span``: seconds
    within which a bare number is an instant. Null, empty, placeholder and impossible texts get an empty array. Columns ``_t*`` are used inside.
    """
    known = sorted(zoneinfo.available_timezones())
    digits = "_t rlike r'^[0-9]+(\\.[0-9]+)?$'"
    fam = "CASE WHEN _t is null or _t = '' THEN null WHEN " + digits + " THEN CASE WHEN length(_t) = 14 and instr(_t, '.') = 0 THEN 'compact' ELSE 'num' END " + " ".join(f"WHEN _t rlike {_q(p)} THEN '{k}'" for k, p in _PATTERNS.items()) + " END"
    head = "CASE _tf " + " ".join(f"WHEN '{k}' THEN regexp_extract(_t, {_q(p)}, 0)" for k, p in _PATTERNS.items()) + " END"
    names = ", ".join(f"'{n}', '{m:02d}'" for m, ns in MONTHS.items() for n in ns.split())
    month = lambda e: f"coalesce(try_element_at(map({names}), lower({e})), '00')"
    g = lambda k, i: f"regexp_extract(_th, {_q(_PATTERNS[k])}, {i})"
    base = f"""CASE _tf WHEN 'iso' THEN _th
      WHEN 'slash' THEN regexp_replace(_th, {_q(_PATTERNS['slash'])}, '$3-$2-$1 $4')
      WHEN 'dot' THEN regexp_replace(_th, {_q(_PATTERNS['dot'])}, '$3-$2-$1 $4')
      WHEN 'compact' THEN regexp_replace(_th, {_q(_PATTERNS['compact'])}, '$1-$2-$3 $4:$5:$6')
      WHEN 'named' THEN concat({g('named', 3)}, '-', {month(g('named', 2))}, '-', {g('named', 1)}, ' ', {g('named', 4)})
      WHEN 'us' THEN CASE WHEN cast({g('us', 4)} as int) between 1 and 12 THEN concat({g('us', 3)}, '-', {month(g('us', 1))}, '-', {g('us', 2)}, ' ',
           cast(cast({g('us', 4)} as int) % 12 + if(lower({g('us', 6)}) = 'p', 12, 0) as string), {g('us', 5)}) END
      WHEN 'date' THEN concat(_th, ' 00:00:00') END"""
    base2 = f"CASE WHEN _tf = 'slash' THEN regexp_replace(_th, {_q(_PATTERNS['slash'])}, '$3-$1-$2 $4') END"
    full = lambda b: f"if(length({b}) - length(replace({b}, ':', '')) = 1, concat({b}, ':00'), {b})"
    local = lambda b: f"unix_micros(try_cast(concat(replace(replace({full(b)}, ',', '.'), 't', 'T'), 'Z') as timestamp))"
    offset = """CASE WHEN _tr = '' THEN null
      WHEN _tr rlike r'^[+-][0-9]{2}:?[0-9]{2}$' THEN array(if(substr(_tr, 1, 1) = '-', -1, 1) * (cast(substr(_tr, 2, 2) as int) * 60 + cast(right(_tr, 2) as int)))
      WHEN _tr rlike r'^[+-][0-9]{2}$' THEN array(if(substr(_tr, 1, 1) = '-', -1, 1) * cast(substr(_tr, 2, 2) as int) * 60)
      WHEN length(_tr) <= 5 THEN coalesce(try_element_at(_tm, upper(_tr)), cast(array() as array<int>))
      ELSE cast(array() as array<int>) END"""
    abbreviations = "map(" + ", ".join(f"'{k}', array({', '.join(map(str, v))})" for k, v in ABBREVIATIONS.items()) + ")"

    def shift(us: str) -> str:
        return f"(unix_micros(from_utc_timestamp(timestamp_micros({us}), _tz)) - {us})"

    day = "86400000000"
    early = lambda us: f"CASE WHEN _to is null AND _tz <> 'UTC' THEN {us} - {shift(f'({us} - {day})')} END"
    late = lambda us: f"CASE WHEN _to is null AND _tz <> 'UTC' THEN {us} - {shift(f'({us} + {day})')} END"

    def cands(us: str, e: str, f: str, fmt: str) -> str:
        """Of a local time: by its offsets, or by the zone of the series, where a clock change gives none or two."""
        ok = lambda u: f"{u} + {shift(u)} = {us}"
        one = lambda u, kind: f"named_struct('us', {u}, 'fmt', {fmt}, 'cost', 0D, 'kind', {kind})"
        two = f"array({one(f'least({e}, {f})', REPEATED)}, {one(f'greatest({e}, {f})', REPEATED)})"
        naive = f"CASE WHEN {e} = {f} THEN array({one(e, PLAIN)}) WHEN {ok(e)} THEN CASE WHEN {ok(f)} THEN {two} ELSE array({one(e, PLAIN)}) END WHEN {ok(f)} THEN array({one(f, PLAIN)}) ELSE array({one(e, SKIPPED)}) END"
        given = f"CASE WHEN size(_to) = 1 THEN array({one(f'({us} - _to[0] * 60000000L)', PLAIN)}) ELSE transform(_to, (o, i) -> named_struct('us', {us} - o * 60000000L, 'fmt', {fmt}, 'cost', i * {RARER}D, 'kind', {PLAIN})) END"
        return f"CASE WHEN {us} is null THEN {_NONE} WHEN _to is not null THEN {given} WHEN _tz = 'UTC' THEN array({one(us, PLAIN)}) ELSE {naive} END"

    fmt = "CASE _tf " + " ".join(f"WHEN '{k}' THEN {FORMATS['dmy' if k == 'slash' else k]}" for k in _PATTERNS) + " END"
    unit = lambda n: f"cast(_tn * {n} as bigint)"
    between = lambda m: f"_tn >= {span[0] * m} AND _tn < {span[1] * m}"
    numeric = "CASE " + " ".join(f"WHEN {between(m)} THEN array(named_struct('us', {u}, 'fmt', {FORMATS[k]}, 'cost', 0D, 'kind', {PLAIN}))" for k, m, u in (("epoch_s", 1, unit(1000000)), ("epoch_ms", 10**3, unit(1000)), ("epoch_us", 10**6, "cast(_tn as bigint)"), ("epoch_ns", 10**9, "cast(_tn as bigint) div 1000"))) + f" ELSE {_NONE} END"
    weighed = lambda c, other: f"if({order} = '{other}', transform({c}, x -> named_struct('us', x.us, 'fmt', x.fmt, 'cost', x.cost + {UNDECLARED}D, 'kind', x.kind)), {c})"
    keep = f"""CASE WHEN _tf = 'num' THEN {numeric} WHEN _tf is null THEN {_NONE}
      WHEN _tf <> 'slash' THEN _c1 ELSE concat({weighed('_c1', 'MDY')}, {weighed('_c2', 'DMY')}) END"""
    named = F.regexp_extract("_tr0", r"\[([^\]]+)\]$", 1)
    step = (
        df.withColumn("_t", F.expr(f"btrim({text}, concat(' ', chr(9), chr(10), chr(13), chr(160)))"))
        .withColumn("_tf", F.expr(fam)).withColumn("_th", F.expr(head))
        .withColumn("_tr0", F.expr("CASE WHEN _tf <> 'num' THEN btrim(substr(_t, length(_th) + 1)) END"))
        .withColumn("_tb", F.when(F.col("_tr0").endswith("]"), named))
        .withColumn("_tr", F.when(F.col("_tb").isNotNull(), F.regexp_replace("_tr0", r"\[[^\]]+\]$", "")).otherwise(F.col("_tr0")))
        .withColumn("_tm", F.expr(abbreviations)).withColumn("_to", F.expr(offset)).drop("_tm")
        .withColumn("_tz", F.when(F.col("_tb").isin(known), F.col("_tb")).when(F.col(zone).isin(known), F.col(zone)).otherwise("UTC"))
        .withColumn("_tn", F.expr("CASE WHEN _tf = 'num' THEN try_cast(_t as decimal(30,9)) END"))
        .withColumn("_b1", F.expr(base)).withColumn("_b2", F.expr(base2))
        .withColumn("_l1", F.expr(local("_b1"))).withColumn("_l2", F.expr(local("_b2")))
    )
    for i in "12":
        step = step.withColumn(f"_e{i}", F.expr(early(f"_l{i}"))).withColumn(f"_f{i}", F.expr(late(f"_l{i}")))
    step = step.withColumn("_fm", F.expr(fmt)).withColumn("_c1", F.expr(cands("_l1", "_e1", "_f1", "_fm"))).withColumn("_c2", F.expr(cands("_l2", "_e2", "_f2", str(FORMATS["mdy"]))))
    inner = ["_t", "_tf", "_th", "_tr0", "_tb", "_tr", "_to", "_tz", "_tn", "_b1", "_b2", "_l1", "_l2", "_e1", "_e2", "_f1", "_f2", "_fm", "_c1", "_c2"]
    return step.withColumn(out, F.expr(keep).cast(_CANDS)).drop(*inner)


class Rows:
    """Interpretations of rows in record order, one column each: instants, costs (infinite where there is none) and formats."""

    def __init__(self, us: np.ndarray, cost: np.ndarray, fmt: np.ndarray):
        self.us, self.cost, self.fmt = us, cost, fmt
        self.many = np.isfinite(cost).sum(axis=1) > 1

    @classmethod
    def of(cls, pdf: pd.DataFrame) -> Rows:
        return cls(*(np.stack([pdf[f"{c}{i}"].to_numpy() for i in range(MOST)], axis=1) for c in "ucm"))

    def __len__(self) -> int:
        return len(self.us)

    def step(self, a, b) -> np.ndarray:
        """Costs from each interpretation of rows ``a`` to each of rows ``b`` (numbers of rows alike in shape)."""
        back = self.us[b][..., None, :] < self.us[a][..., :, None]
        switch = self.fmt[b][..., None, :] != self.fmt[a][..., :, None]
        return SWITCH * switch + BACK * back


def viterbi(rows: Rows, breaks: np.ndarray | None = None, first: int | None = None, last: int | None = None) -> np.ndarray:
    """The cheapest interpretation of each row; ``first`` and ``last`` fix the ends. Ties go to the earlier interpretation.

    ``breaks`` marks rows whose forerunner isn't the row before; both then have one interpretation.
    Stretches of rows with several interpretations are searched side by side, one step of all of them at a time.
    """
    n, pick = len(rows), np.zeros(len(rows), dtype=np.int64)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], rows.many.astype(np.int8), [0]])))
    lo, hi = edge[::2], edge[1::2]
    if not len(lo):
        return pick
    order = np.argsort(lo - hi, kind="stable")  # longest first: a step's stretches are a head of the list
    lo, hi = lo[order], hi[order]
    size = hi - lo
    best = rows.cost[lo].copy()
    cut = np.zeros(n, dtype=bool) if breaks is None else breaks
    before = (lo > 0) & ~cut[lo]
    if before.any():  # the row before has one interpretation, number 0
        best[before] += rows.step(lo[before] - 1, lo[before])[:, 0, :]
    if first is not None:
        best[lo == 0] = np.where(np.arange(MOST) == first, best[lo == 0], np.inf)
    trace = []
    for i in range(1, int(size[0])):
        m = int(np.searchsorted(-size, -i, side="left"))  # stretches with more than i rows
        at = lo[:m] + i
        total = best[:m, :, None] + rows.step(at - 1, at) + rows.cost[at][:, None, :]
        trace.append(total.argmin(axis=1))
        best[:m] = total.min(axis=1)
    after = (hi < n) & ~cut[np.minimum(hi, n - 1)]
    if after.any():
        best[after] += rows.step(hi[after] - 1, hi[after])[:, :, 0]
    at = best.argmin(axis=1)
    if last is not None:
        at[hi == n] = last
    pick[hi - 1] = at
    for i in range(int(size[0]) - 1, 0, -1):
        m = int(np.searchsorted(-size, -i, side="left"))
        pick[lo[:m] + i - 1] = np.take_along_axis(trace[i - 1], pick[lo[:m] + i][:, None], axis=1)[:, 0]
    return pick


def _ends(rows: Rows) -> np.ndarray:
    """The cheapest cost from each interpretation of the first row to each of the last (up to a constant)."""
    single, n = np.flatnonzero(~rows.many), len(rows)

    def sweep(lo: int, hi: int) -> np.ndarray:
        cost = np.where(np.eye(MOST, dtype=bool), rows.cost[lo][:, None], np.inf)
        for i in range(lo + 1, hi):
            cost = (cost[:, :, None] + rows.step(i - 1, i)[None]).min(axis=1) + rows.cost[i]
        return cost

    if not len(single):
        return sweep(0, n)
    return sweep(0, single[0] + 1)[:, :1] + sweep(single[-1], n)[:1, :]


def _summary(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("_i")
    rows = Rows.of(pdf)
    return pd.DataFrame({"_src": [pdf["_src"].iloc[0]], "_blk": [pdf["_blk"].iloc[0]], "_ends": [_ends(rows).ravel().tolist()],
                         **{f"_{side}{c}": [v[i].tolist()] for side, i in (("a", 0), ("b", -1)) for c, v in (("u", rows.us), ("c", rows.cost), ("m", rows.fmt))}})


def _fix_ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """Over a source's blocks: the interpretation of the first and the last row of each."""
    pdf = pdf.sort_values("_blk")
    n = len(pdf)
    pairs = Rows(*(np.stack([np.array([list(x) for x in pdf[f"_{side}{c}"]]) for side in "ab"], axis=1).reshape(2 * n, MOST) for c in "ucm"))
    ends = np.array([list(x) for x in pdf["_ends"]]).reshape(n, MOST, MOST)
    best, trace = ends[0].min(axis=0), [(ends[0].argmin(axis=0), None)]
    for i in range(1, n):
        enter = best[:, None] + pairs.step(2 * i - 1, 2 * i)
        came, enter = enter.argmin(axis=0), enter.min(axis=0)
        total = enter[:, None] + ends[i]
        trace.append((total.argmin(axis=0), came))
        best = total.min(axis=0)
    at, first, last = int(best.argmin()), [], []
    for start, came in reversed(trace):
        last.append(at)
        first.append(int(start[at]))
        at = int(came[first[-1]]) if came is not None else 0
    return pd.DataFrame({"_src": pdf["_src"].to_numpy(), "_blk": pdf["_blk"].to_numpy(), "_first": first[::-1], "_last": last[::-1]})


def _choose(keys: list[str]):
    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        rows, i = Rows.of(pdf), pdf["_i"].to_numpy()
        breaks = np.diff(i, prepend=i[0] - 1) != 1
        pick = viterbi(rows, breaks, int(pdf["_first"].iloc[0]), int(pdf["_last"].iloc[0]))[:, None]
        out = pdf[[*keys, "_n"]].assign(_us=np.take_along_axis(rows.us, pick, 1)[:, 0], _m=np.take_along_axis(rows.fmt, pick, 1)[:, 0])
        kinds = np.stack([pdf[f"k{j}"].to_numpy() for j in range(MOST)], axis=1)
        return out.assign(_kind=np.take_along_axis(kinds, pick, 1)[:, 0])[rows.many]

    return choose


def resolve_instants(df: DataFrame, text: str, key: list[str], source: str, order: str, zone: str | None = None, day_order: str | None = None, block_rows: int = 65_536, span: tuple[int, int] = (FIRST_S, LAST_S)) -> DataFrame:
    """Each row's instant: ``key``, ``utc_ms``, ``fmt``, ``status``, ``n_interpretations``.

    ``order`` is the integer record order of a source; ties are ordered by the text.
    status: ``stated`` (all interpretations of the text are one instant), ``inferred`` (the search chose
    among several), ``repeated`` (a clock time that a clock change repeats: the search's
    choice stands in utc_ms, but the text doesn't state it) and ``none`` (null, empty,
    placeholder or impossible text, or a clock time that a change skips: utc_ms is null).
    Rows without a source form one source; rows without an order are searched in order of their texts, apart from the others. Repeated rows
    each keep a row. An empty table gives an empty result. Other columns are ignored.
    """
    cols = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    slim = df.select(*cols, F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_src"), F.col(order).cast("bigint").alias("_ord"),
                     F.col(text).alias("_txt"), (F.col(zone) if zone else F.lit(None).cast("string")).alias("_zone"), (F.upper(F.col(day_order)) if day_order else F.lit(None).cast("string")).alias("_do"))
    slim = with_interpretations(slim, "_txt", "_zone", "_do", "_cands", span).drop("_zone", "_do")
    keys = [f"_k{i}" for i in range(len(key))]
    block = F.when(F.col("_ord").isNull(), -1 - F.pmod(F.xxhash64("_txt"), F.lit(4096))).otherwise(F.expr(f"_ord div {block_rows}"))
    slim = materialize(slim.select(*keys, "_src", "_ord", F.when(F.size("_cands") > 1, F.col("_txt")).alias("_txt"), "_cands", block.alias("_blk")), "instants")
    open_ = slim.filter(F.size("_cands") > 1).select("_src").distinct()
    some = slim.filter(F.size("_cands") > 0).join(open_, "_src", "left_semi")
    by = Window.partitionBy("_src", "_blk").orderBy("_ord", "_txt")
    several = F.size("_cands") > 1
    near = several | F.coalesce(F.lag(several).over(by), F.lit(True)) | F.coalesce(F.lead(several).over(by), F.lit(True))  # and the ends of the block
    at = lambda i, field, other: F.coalesce(F.get("_cands", F.lit(i))[field], F.lit(other))
    flat = [at(i, f, o).alias(f"{c}{i}") for c, f, o in (("u", "us", 0), ("c", "cost", float("inf")), ("m", "fmt", 0), ("k", "kind", 0)) for i in range(MOST)]
    different = F.size(F.array_distinct(F.col("_cands")["us"]))  # the fifth of May reads alike in both orders
    inside = some.withColumn("_i", F.row_number().over(by)).withColumn("_near", near).filter("_near").select(*keys, "_src", "_blk", "_i", different.alias("_n"), *flat)
    # few bytes but much work: by a number of partitions of its own, which aren't joined
    inside = materialize(inside, "search").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_src", "_blk")
    side = ", ".join(f"_{s}{c} array<{t}>" for s in "ab" for c, t in (("u", "bigint"), ("c", "double"), ("m", "int")))
    ends = inside.drop(*keys).groupBy("_src", "_blk").applyInPandas(_summary, f"_src string, _blk bigint, _ends array<double>, {side}")
    fixed = ends.groupBy("_src").applyInPandas(_fix_ends, "_src string, _blk bigint, _first int, _last int")
    kinds = dict(slim.dtypes)
    chosen = inside.join(fixed, ["_src", "_blk"]).groupBy("_src", "_blk").applyInPandas(_choose(keys), ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_n int, _us bigint, _m int, _kind int"]))
    got = F.try_element_at("_cands", F.lit(1))
    settled = slim.filter(F.size("_cands") <= 1).select(*keys, F.size("_cands").alias("_n"), got["us"].alias("_us"), got["fmt"].alias("_m"), got["kind"].alias("_kind"))
    both = settled.unionByName(chosen)
    known = F.coalesce(F.col("_kind") != SKIPPED, F.lit(False))
    return both.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], F.when(known, F.expr("cast(floor(_us / 1000) as bigint)")).alias("utc_ms"), F.when(known, F.col("_m")).alias("fmt"),
        F.when(~known, "none").when(F.col("_kind") == REPEATED, "repeated").when(F.col("_n") > 1, "inferred").otherwise("stated").alias("status"), F.when(known, F.col("_n")).otherwise(0).alias("n_interpretations"))
