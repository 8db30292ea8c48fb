"""The catalogue's results stated in SQL, from the given tables alone.

Each statement is written from the definition of the result, not from the
DataFrame code: shares instead of power sums, ranks by ``row_number`` instead
of sketches, grid distance instead of shared vertices.
"""

from __future__ import annotations


# The choices of the given analog, and the panel's measures, written out apart from the plans.
GRID, YEAR0 = 25, 1995
DIVERSITY = {"SIDI": "LSM_SIDI_ALL", "SHDI": "LSM_SHDI_ALL", "RICH": "LSM_RICH_ALL"}
CLIMATE = {"GDD": "GDD", "SDD": "SDD", "TP": "TP"}
WATER = {"Vol": "volume"}
EXPENSES = {"fert": "fert", "herb": "herb"}
MEASURES = {**DIVERSITY, **CLIMATE, **WATER}
MODEL_COLUMNS = """
fert herb volume TP GDD SDD SOIL PERC_IRR ACRES LSM_SIDI_ALL LSM_SHDI_ALL LSM_RICH_ALL
lagvolume lagTP lagGDD lagSDD lagSIDI lagSHDI lagRICH
dSIDI dSHDI dRICH dGDD dSDD dTP dVol dfert dherb
aveSIDI2yr aveSHDI2yr aveRICH2yr aveSIDI3yr aveSHDI3yr aveRICH3yr
aveGDD2yr aveSDD2yr aveTP2yr aveVol2yr aveGDD3yr aveSDD3yr aveTP3yr aveVol3yr
avefert2yr aveherb2yr avefert3yr aveherb3yr
covSIDI covSHDI covRICH covGDD covSDD covTP covVol covfert covherb
""".split()
OVER = "partition by crop, GEOID order by Yr"
FRAMES = {2: "rows between current row and 1 following", 3: "rows between 1 preceding and 1 following"}


def r6(x: str, name: str = "") -> str:
    """Rounded to six decimals, in the same arithmetic as ``basics.tidy``."""
    return f"floor(({x}) * 1e6 + 0.5) / 1e6 as {name or x}"


def r9(x: str, name: str) -> str:
    """Nine decimals, for plain sums of measures that are stored with nine."""
    return f"floor(({x}) * 1e9 + 0.5) / 1e9 as {name}"


def finite(x: str) -> str:
    return f"case when isfinite({x}) then {x} end"


def _full(x: str, width: int) -> str:
    f = f"({OVER} {FRAMES[width]})"
    return f"count(*) over {f} = {width} and count(*) filter (where isinf({x})) over {f} = 0"


def _agg(fn: str, x: str, width: int) -> str:
    return f"{fn}({finite(x)}) over ({OVER} {FRAMES[width]})"


def mean(x: str, width: int) -> str:
    return f"case when {_full(x, width)} then {_agg('avg', x, width)} end"


def cv(x: str) -> str:
    ratio = f"{_agg('stddev_samp', x, 3)} / nullif({_agg('avg', x, 3)}, 0)"
    return f"case when {_full(x, 3)} then {ratio} end"


def change(x: str) -> str:
    nxt = f"lead({x}) over ({OVER})"
    return f"case when isfinite({nxt}) and isfinite({x}) then ({nxt}) - {x} end"


def lag(x: str) -> str:
    return f"lag({x}) over ({OVER})"


def spread(measures: dict[str, str]) -> dict[str, str]:
    out = {}
    for s, x in measures.items():
        out |= {f"d{s}": change(x), f"ave{s}2yr": mean(x, 2), f"ave{s}3yr": mean(x, 3), f"cov{s}": cv(x)}
    return out


def named(columns: dict[str, str]) -> str:
    return ",\n  ".join(f"{e} as {n}" for n, e in columns.items())


BUILT = {"dYield": change("YIELD"), "covYield": cv("YIELD"), **spread(MEASURES)} | {
    f"lag{x if s == 'Vol' else s}": finite(lag(x)) for s, x in MEASURES.items()
}
PREPARED = spread({**WATER, **EXPENSES})
KEPT = [c for c in BUILT if c not in PREPARED]
OUTCOMES = ["YIELD", "dYield", "covYield"]

CTES: dict[str, str] = {}

CTES["lines"] = """
select c_mktsegment as crop, cast(l_suppkey as varchar) as GEOID,
  cast(year(o_orderdate) as integer) as YEAR, p_type, p_size, l_returnflag, l_linestatus,
  o_orderpriority, cast(l_quantity as decimal(15,2)) as qty,
  cast(l_extendedprice as decimal(15,2)) as price, cast(l_discount as decimal(15,2)) as discount,
  cast(l_tax as decimal(15,2)) as tax, cast(o_totalprice as decimal(15,2)) as total
from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey join part on l_partkey = p_partkey"""

CTES["shares"] = """
select crop, GEOID, YEAR, p_type,
  cast(sum(qty) as double) / sum(cast(sum(qty) as double)) over (partition by crop, GEOID, YEAR) as p
from lines group by crop, GEOID, YEAR, p_type"""

CTES["indices"] = """
select crop, GEOID, YEAR, 1 - sum(p * p) as simpson, -sum(p * ln(p)) as shannon, count(*) as richness
from shares group by crop, GEOID, YEAR"""

CTES["cells"] = """
select crop, GEOID, YEAR, cast(count(*) as double) as n, cast(sum(qty) as double) as qty,
  cast(sum(case when l_returnflag = 'R' and l_linestatus = 'F' then price * (1 - discount) else 0 end)
    as double) as net_rf,
  cast(sum(case when l_returnflag = 'R' and l_linestatus = 'F' then qty else 0 end) as double) as qty_rf,
  cast(sum(case when l_linestatus = 'O' then qty else 0 end) as double) as qty_o,
  cast(sum(discount) as double) as discount, cast(sum(tax) as double) as tax,
  cast(sum(total) as double) as total
from lines group by crop, GEOID, YEAR"""

CTES["panel"] = f"""
select crop, GEOID, YEAR, r_name as STATE,
  round(net_rf / nullif(qty_rf, 0), 12) as YIELD,
  round(simpson, 12) as LSM_SIDI_ALL, round(shannon, 12) as LSM_SHDI_ALL,
  cast(richness as double) as LSM_RICH_ALL, round(tax / n, 12) as GDD,
  round(total / n / 1000, 12) as SDD, round(discount / n, 12) as TP,
  round(s_acctbal / 1000, 12) as SOIL, round(100 * qty_o / qty, 12) as PERC_IRR, qty as ACRES,
  sum(qty) over (partition by GEOID, YEAR) as TOTAL_ACRES,
  YEAR - {YEAR0} as Yr, GEOID || '_' || cast(YEAR - {YEAR0} as varchar) as Cnty_yr
from cells join indices using (crop, GEOID, YEAR)
join supplier on GEOID = cast(s_suppkey as varchar)
join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""

CTES["water"] = f"""
select crop, GEOID || '_' || cast(YEAR - {YEAR0} as varchar) as Cnty_yr,
  cast(sum(price) as double) / count(*) as avg_water,
  cast(max(price) - min(price) as double) as range_water,
  cast(sum(price) as varchar) as volume
from lines where l_returnflag = 'A' group by crop, GEOID, YEAR"""

CTES["watered"] = """
select panel.*, avg_water, range_water, volume
from panel left join water
  on panel.crop is not distinct from water.crop and panel.Cnty_yr is not distinct from water.Cnty_yr"""

CTES["logged"] = """
select * replace (
  case when YIELD = 0 then '-infinity'::double when YIELD > 0 then ln(YIELD) end as YIELD,
  case when try_cast(volume as double) = 0 then '-infinity'::double
    when try_cast(volume as double) > 0 then ln(try_cast(volume as double)) end as volume)
from watered"""

CTES["built"] = f"select *,\n  {named(BUILT)}\nfrom logged"

CTES["nodes"] = """
select crop, GEOID, cast(row_number() over (partition by crop order by GEOID) as integer) as CNTY
from (select distinct crop, GEOID from built where YIELD is not null)
where GEOID in (select cast(s_suppkey as varchar) from supplier)"""


CTES["years"] = "select distinct cast(year(o_orderdate) as integer) as year from orders where o_orderdate is not null"


def long(priority: str, value: str) -> str:
    """Spending per supplier and year, a row without value for a year without spending."""
    return f"""
select GEOID, year, year - {YEAR0} as Yr, {value}, GEOID || '_' || cast(year - {YEAR0} as varchar) as Cnty_yr
from (select distinct GEOID from lines where o_orderpriority = '{priority}') cross join years
left join (select GEOID, YEAR as year, cast(sum(price) as double) as {value} from lines
  where o_orderpriority = '{priority}' group by all) using (GEOID, year)"""


CTES["fert_long"], CTES["herb_long"] = long("1-URGENT", "fert"), long("2-HIGH", "herb")

CTES["normalised"] = f"""
select crop, GEOID, YEAR, STATE, Yr, CNTY, {finite('YIELD')} as YIELD, {', '.join(KEPT)},
  LSM_SIDI_ALL, LSM_SHDI_ALL, LSM_RICH_ALL, GDD, SDD, TP, SOIL, PERC_IRR, ACRES, TOTAL_ACRES,
  {finite('volume')} / nullif(TOTAL_ACRES, 0) as volume,
  fert / nullif(TOTAL_ACRES, 0) as fert, herb / nullif(TOTAL_ACRES, 0) as herb
from built left join nodes using (crop, GEOID)
left join (select Cnty_yr, fert from fert_long) using (Cnty_yr)
left join (select Cnty_yr, herb from herb_long) using (Cnty_yr)
where YIELD is not null"""

CTES["prepared_raw"] = f"select *,\n  {named(PREPARED)}\nfrom normalised"

# The prepared table stores measures with nine decimals, so that values that
# are equal but for the last bits of floating point arithmetic bin alike.
CTES["prepared"] = (
    "select crop, GEOID, YEAR, STATE, Yr, CNTY, TOTAL_ACRES, "
    + ", ".join(f"round({c}, 9) as {c}" for c in [*OUTCOMES, *MODEL_COLUMNS])
    + " from prepared_raw"
)

CTES["cols_long"] = (
    "select crop, GEOID, YEAR, col, x from (select crop, GEOID, YEAR, "
    + ", ".join(MODEL_COLUMNS)
    + " from prepared) unpivot (x for col in ("
    + ", ".join(MODEL_COLUMNS)
    + "))"
)

CTES["ranked"] = """
select crop, col, x, row_number() over (partition by crop, col order by x) as rn,
  count(*) over (partition by crop, col) as n
from cols_long"""

CTES["places"] = """
select distinct crop, col, n, 1 + (num * (n - 1)) // 38 as lo, ((num * (n - 1)) % 38) / 38.0::double as part
from ranked, (select 0 as num union all select 38 union all select 2 * i - 1 from range(1, 20) t(i))"""

CTES["breaks"] = """
select crop, col, list(distinct q order by q) as b from (
  select p.crop, p.col, a.x + (z.x - a.x) * part as q from places p
  join ranked a on a.crop = p.crop and a.col = p.col and a.rn = lo
  join ranked z on z.crop = p.crop and z.col = p.col and z.rn = least(lo + 1, p.n))
group by crop, col"""

CTES["binned"] = """
select *, median(x) over (partition by crop, col, bin) as v from (
  select crop, GEOID, YEAR, col, x, greatest(1, len(list_filter(b, lambda e: e < x))) as bin
  from cols_long join breaks using (crop, col))"""

CTES["scaled"] = """
select crop, GEOID, YEAR, col, bin, x, v,
  (v - avg(v) over (partition by crop, col))
    / nullif(stddev_samp(v) over (partition by crop, col), 0) as z
from binned"""

CTES["squares"] = f"""
select cast(s_suppkey as varchar) as GEOID, s_suppkey % {GRID} as gx, s_suppkey // {GRID} as gy from supplier"""

CTES["rook"] = """
select a.GEOID as i, b.GEOID as j from squares a
join (select 1 as dx, 0 as dy union all select -1, 0 union all select 0, 1 union all select 0, -1) on true
join squares b on b.gx = a.gx + dx and b.gy = a.gy + dy"""

CTES["queen"] = """
select a.GEOID as i, b.GEOID as j from squares a
join (select x as dx, y as dy from range(-1, 2) t(x), range(-1, 2) u(y) where x <> 0 or y <> 0) on true
join squares b on b.gx = a.gx + dx and b.gy = a.gy + dy"""

CTES["edges"] = """
select n.crop, n.CNTY as i, m.CNTY as j from rook join nodes n on n.GEOID = rook.i
join nodes m on m.GEOID = rook.j and m.crop = n.crop"""


def statement(tail: str, **extra: str) -> str:
    """``tail`` with every table definition it may use ahead of it; recursions read ``chain`` tables, which are kept."""
    kept = lambda k: " materialized" if k.startswith("chain") else ""
    ctes = ",\n".join(f"{k} as{kept(k)} ({v})" for k, v in {**CTES, **extra}.items())
    return f"with recursive {ctes}\n{tail}"
