"""Tables behind the dashboard, and a self-contained page that draws them."""

from __future__ import annotations

import html
import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stridefold import config
from stridefold.functions.scalars import number
from stridefold.operators.metrics import YEAR
from stridefold.plans.models import BENCHMARK, METRICS, Backtest

RUN = ("symbol", "strategy", "cfg_id")


def chained(rows: DataFrame, value: str, keys: tuple[str, ...], name: str) -> DataFrame:
    """Folds end to end, each rescaled to begin where the one before ended; the last row of a timestamp stays."""
    fold = Window.partitionBy(*keys, "fold").orderBy("t")
    whole = fold.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.select(*keys, "fold", "t", "ts", (F.col(value) / F.first(value).over(whole)).alias("within"), (F.last(value).over(whole) / F.first(value).over(whole)).alias("growth"))
    before = Window.partitionBy(*keys).orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    growth = rows.where("t = 0").select(*keys, "fold", F.coalesce(F.product("growth").over(before), number(1.0)).alias("reached"))
    out = rows.join(growth, [*keys, "fold"]).select(*keys, "fold", "t", "ts", (config.INITIAL_VALUE * F.col("reached") * F.col("within")).alias(name))
    latest = Window.partitionBy(*keys, "ts").orderBy(F.desc("fold"), F.desc("t"))
    return out.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n")


def equity_curve(executed: DataFrame) -> DataFrame:
    return chained(executed, "equity", RUN, "equity")


def buy_and_hold_curve(test: DataFrame) -> DataFrame:
    """From prices; a bar without one leaves the curve where it was."""
    w = Window.partitionBy("symbol", "fold").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    filled = test.withColumn("close", F.coalesce(F.last("close", ignorenulls=True).over(w), number(1.0)))
    return chained(filled, "close", ("symbol",), "bh_equity")


def drawdowns(curve: DataFrame, value: str = "equity", keys: tuple[str, ...] = RUN) -> DataFrame:
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("drawdown", F.try_divide(F.col(value) - peak, peak))


def rolling_sharpe(curve: DataFrame, value: str = "equity", keys: tuple[str, ...] = RUN, window: int = 63) -> DataFrame:
    """Annualised Sharpe of the last ``window`` returns, where there are as many and they vary."""
    w = Window.partitionBy(*keys).orderBy("ts")
    frame = w.rowsBetween(1 - window, 0)
    r = curve.withColumn("r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1 - config.RISK_FREE).where("r is not null")
    r = r.select(*keys, "ts", F.avg("r").over(frame).alias("m"), F.stddev_samp("r").over(frame).alias("s"), F.count("r").over(frame).alias("n"))
    return r.where((F.col("n") == window) & (F.col("s") > 1e-12)).select(*keys, "ts", (F.col("m") / F.col("s") * YEAR).alias("rolling_sharpe"))


def histogram(returns: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Counts in min(80, max(20, n // 10)) equal bins from the least to the greatest return."""
    ends = returns.groupBy(*keys).agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.least(F.lit(80), F.greatest(F.lit(20), F.floor(F.count("*") / 10))).cast("int").alias("bins"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("r") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("bins")).cast("int"), F.col("bins") - 1)).otherwise(0)
    return returns.join(ends, list(keys)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"), F.first("bins").alias("bins"))


def moments(returns: DataFrame, keys: tuple[str, ...] = RUN) -> DataFrame:
    """Population skewness and excess kurtosis, mean and sample deviation."""
    return returns.groupBy(*keys).agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.skewness("r").alias("skewness"), F.kurtosis("r").alias("excess_kurtosis"))


def normal_curve(moment: DataFrame, ends: DataFrame, keys: tuple[str, ...] = RUN, points: int = 300) -> DataFrame:
    """The normal density with the same mean and deviation, at even points from ``lo`` to ``hi``."""
    x = moment.join(ends, list(keys)).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("k"))
    x = x.withColumn("x", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (points - 1))
    z = (F.col("x") - F.col("mean")) / F.col("std")
    return x.select(*keys, "k", "x", (F.exp(-z * z / 2) / (F.col("std") * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def bar_colour(sharpe: Column, bh_sharpe: Column, bh_mean: Column) -> Column:
    """Positive where a fold reaches the benchmark's Sharpe (else the benchmark's mean, else 0)."""
    return F.when(sharpe >= F.coalesce(bh_sharpe, bh_mean, number(0.0)), "positive").otherwise("negative")


def parameter_series(fitted: DataFrame) -> DataFrame:
    return fitted.select("symbol", "strategy", "fold", F.explode("params").alias("key", "value"))


def cumulative_percent(curve: DataFrame, value: str = "equity", keys: tuple[str, ...] = RUN) -> DataFrame:
    """What is drawn where a strategy has no parameters."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return curve.withColumn("percent", 100 * (F.col(value) / first - 1))


def _series(frame: DataFrame, x: str, y: str) -> dict[str, list]:
    rows = frame.select(F.col(x).cast("string"), F.col(y).cast("double")).orderBy(x).collect()  # one symbol's bars
    return {"x": [r[0] for r in rows], "y": [r[1] for r in rows]}


def _counts(returns: DataFrame) -> dict[str, Any]:
    """Every bin's count, empty ones too, and the ends of the bins."""
    rows = histogram(returns).collect()
    ends = returns.agg(F.min("r").alias("lo"), F.max("r").alias("hi")).first()
    counts = [0] * (rows[0].bins if rows else 1)
    for r in rows:
        counts[r.bin] = r.n
    return {"lo": ends.lo, "hi": ends.hi, "y": counts}


def dashboard_data(run: Backtest, symbol: str) -> dict:
    """All six panels of one symbol, as plain data."""
    own = lambda f: f.where(F.col("symbol") == symbol)
    curve, returns = own(equity_curve(run.executed)), own(run.returns)
    rows = own(run.summary).collect()
    params = own(parameter_series(run.fitted)).orderBy("key", "fold").collect() if "params" in run.fitted.columns else []
    evolution: dict[str, list] = {}
    for r in params:
        evolution.setdefault(r["key"], []).append([r["fold"], r["value"]])
    folds = own(run.windows).select("fold", "sharpe_ratio").orderBy("fold").collect()
    bh = rows[0]["per_window_benchmark_sharpes"] if rows else []
    return {
        "equity": _series(curve, "ts", "equity"),
        "buy_and_hold": _series(own(buy_and_hold_curve(run.test)), "ts", "bh_equity"),
        "drawdown": _series(drawdowns(curve), "ts", "drawdown"),
        "rolling_sharpe": _series(rolling_sharpe(curve), "ts", "rolling_sharpe"),
        "histogram": _counts(returns),
        "moments": moments(returns).select("mean", "std", "skewness", "excess_kurtosis").first().asDict(),
        "fold_sharpes": [[r.fold, r.sharpe_ratio, "positive" if r.sharpe_ratio >= (bh[i] if i < len(bh) else 0.0) else "negative"] for i, r in enumerate(folds)],
        "parameters": evolution or {"cumulative %": [[p[0], p[1]] for p in zip(*_series(cumulative_percent(curve), "ts", "percent").values())]},
        "summary": {k: rows[0][k] for k in (*METRICS, *BENCHMARK) if rows and k in rows[0]},
    }


_HEAD = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px system-ui;margin:24px;max-width:1100px}}svg{{width:100%;height:210px;background:#fafafa}}h2{{font-size:15px;margin:18px 0 4px}}td,th{{padding:1px 12px 1px 0;text-align:left}}text{{font:11px system-ui;fill:#555}}</style>
<h1>{title}</h1>"""

_PAGE = (
    _HEAD
    + """<table id="s"></table><p id="n"></p><div id="p"></div>
<script>const d={data};
const num=v=>!Number.isFinite(v)?'':Math.abs(v)>=1000?v.toFixed(0):+v.toPrecision(3);
// a panel: a frame of 60..990 by 10..180, its ends written on both axes
const S=(t,b,y,x)=>{{const u='<line x1="60" x2="990" y1="180" y2="180" stroke="#bbb"/><line x1="60" x2="60" y1="10" y2="180" stroke="#bbb"/>',
 l=(a,c,e,v)=>'<text x="'+a+'" y="'+c+'" text-anchor="'+e+'">'+v+'</text>';
 p.insertAdjacentHTML('beforeend','<h2>'+t+'</h2><svg viewBox="0 0 1000 200">'+u+b+l(55,18,'end',num(y[1]))+l(55,180,'end',num(y[0]))+l(60,196,'start',x[0])+l(990,196,'end',x[1])+'</svg>')}};
const ends=(ys)=>{{const v=ys.filter(Number.isFinite);return v.length?[Math.min(...v),Math.max(...v)]:[0,1]}};
const fit=([a,z])=>y=>180-170*(y-a)/((z-a)||1);
const line=(ys,f,c)=>'<polyline fill="none" stroke="'+c+'" points="'+ys.map((y,i)=>Number.isFinite(y)?[60+930*i/Math.max(1,ys.length-1),f(y)].join():'').join(' ')+'"/>';
const bars=(ys,f,cs)=>{{const w=930/Math.max(1,ys.length);return ys.map((y,i)=>'<rect x="'+(60+w*i)+'" width="'+w*.9+'" y="'+Math.min(f(y),f(0))+'" height="'+Math.abs(f(y)-f(0))+'" fill="'+cs(i)+'"/>').join('')}};
const days=x=>x.length?[x[0].slice(0,10),x[x.length-1].slice(0,10)]:['',''];
const plot=(t,xs,...ls)=>{{const y=ends(ls.flatMap(l=>l[0]));S(t,ls.map(l=>line(l[0],fit(y),l[1])).join(''),y,xs)}};
plot('Equity (blue) and buy and hold (grey)',days(d.equity.x),[d.buy_and_hold.y,'#999'],[d.equity.y,'#2563eb']);
plot('Drawdown',days(d.drawdown.x),[d.drawdown.y,'#dc2626']);
plot('Rolling Sharpe, 63 bars',days(d.rolling_sharpe.x),[d.rolling_sharpe.y,'#2563eb']);
{{const y=ends([0,...d.fold_sharpes.map(x=>x[1])]);S('Sharpe by fold (green: buy and hold reached)',bars(d.fold_sharpes.map(x=>x[1]),fit(y),i=>d.fold_sharpes[i][2]=='positive'?'#16a34a':'#dc2626'),y,['fold 0','fold '+(d.fold_sharpes.length-1)])}}
{{const h=d.histogram,m=d.moments,n=h.y.reduce((a,b)=>a+b,0),w=(h.hi-h.lo)/h.y.length,k=300,
 c=m.std>0?Array.from({{length:k}},(_,i)=>{{const z=(h.lo+(h.hi-h.lo)*i/(k-1)-m.mean)/m.std;return n*w*Math.exp(-z*z/2)/(m.std*Math.sqrt(2*Math.PI))}}):[],y=ends([0,...h.y,...c]);
 S('Daily returns and the Normal curve: skewness '+num(+m.skewness)+', excess kurtosis '+num(+m.excess_kurtosis),bars(h.y,fit(y),()=>'#93c5fd')+line(c,fit(y),'#dc2626'),y,[num(h.lo),num(h.hi)])}}
for(const [k,v] of Object.entries(d.parameters)){{const y=v.map(x=>x[1]);plot(k.replaceAll('_',' '),[String(v[0]?.[0]??'').slice(0,10),String(v[v.length-1]?.[0]??'').slice(0,10)],[y,'#7c3aed'])}}
s.innerHTML=Object.entries(d.summary).map(([k,v])=>'<tr><td>'+k+'<td>'+v).join('');
n.textContent=d.note;
</script>"""
)


def _heat(p: float | None) -> str:
    """Green for a small p, red for a large one, grey for none."""
    return "#ddd" if p is None or p != p else f"hsl({120 * (1 - p):.0f},70%,72%)"


def build_heatmap(sweeps: dict[str, DataFrame], path: str | Path) -> Path:
    """A page of Fisher's p by cost and slippage, a table for each named sweep of one symbol."""
    body = []
    for name, sweep in sweeps.items():
        cells = {(r.cost, r.slippage): r.fisher_p for r in sweep.collect()}
        costs, slips = (sorted({k[i] for k in cells}) for i in (0, 1))
        head = "<tr><th>cost \\ slippage" + "".join(f"<th>{x:.3f}" for x in slips)
        rows = "".join(f"<tr><th>{c:.4f}" + "".join(f'<td style="background:{_heat(cells[c, x])};padding:6px 14px">' + ("N/A" if cells[c, x] != cells[c, x] else f"{cells[c, x]:.3f}") for x in slips) for c in costs)
        body.append(f"<h2>{html.escape(name)}: Fisher p</h2><table>{head}{rows}</table>")
    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    where.write_text(_HEAD.format(title="Cost sensitivity") + "".join(body) + "<p>Green: a small p, evidence of an edge. Red: none.</p>")
    return where


def build_dashboard(run: Backtest, symbol: str, path: str | Path) -> Path:
    """Write the page of one symbol; it needs nothing but itself."""
    from stridefold.sources.sinks import plain, verdict_text

    where = Path(path)
    where.parent.mkdir(parents=True, exist_ok=True)
    panels = dashboard_data(run, symbol)
    m = panels["summary"]
    panels["note"] = verdict_text(*(m.get(k, float("nan")) for k in ("combined_p_value", "reality_check_p_value", "reality_check_bh_p_value"))) if m else ""
    data = json.dumps(plain(panels)).replace("</", "<\\/")
    where.write_text(_PAGE.format(title=html.escape(f"{run.name}: {symbol}"), data=data))
    return where
