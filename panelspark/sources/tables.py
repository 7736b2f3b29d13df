"""Tables of the panel, derived in SQL from the star schema. The text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.files import fresh_path

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels")

#: What of a first open its issue cost.
ISSUE = 0.8

VIEWS = {
    "bars": """SELECT CASE n % 4 WHEN 0 THEN 'sh.6000' WHEN 1 THEN 'sh.6880' WHEN 2 THEN 'sz.3000' ELSE 'sz.0000' END || lpad(CAST(n AS STRING), 2, '0') AS code,
  d AS date, avg(px) AS open, max(px) AS high, min(px) AS low, sum(ext)/sum(qty) AS close, sum(qty) AS volume, sum(ext) AS amount, sum(qty)/500.0 AS turn,
  (sum(ext)/sum(qty)) / nullif(round(sum(ext*(disc-0.03))/sum(qty), 9), 0) AS pe_ttm, (sum(ext)/sum(qty)) / avg(retail) AS pb_mrq, n % 11 = 0 AS is_st
FROM (SELECT CAST(replace(p_brand,'Brand#','') AS INT) AS n, CAST(l_shipdate AS DATE) AS d, l_extendedprice/l_quantity AS px, l_extendedprice AS ext, l_quantity AS qty,
  l_discount AS disc, p_retailprice AS retail FROM lineitem JOIN part ON l_partkey = p_partkey) t GROUP BY n, d""",
    "calendar": "SELECT date, row_number() OVER (ORDER BY date) AS pos FROM (SELECT DISTINCT date FROM bars) t",
    "codes": "SELECT DISTINCT code FROM bars",
    "dense": "SELECT c.date, c.pos, k.code, b.open, b.high, b.low, b.close, b.volume, b.amount, b.turn, b.pe_ttm, b.pb_mrq, b.is_st FROM calendar c CROSS JOIN codes k LEFT JOIN bars b ON b.date = c.date AND b.code = k.code",
    "rets": "SELECT *, close / lag(close) OVER (PARTITION BY code ORDER BY pos) - 1 AS ret FROM dense",
    "month_ends": "SELECT max(date) AS date FROM calendar GROUP BY date_trunc('month', date)",
    "membership": """SELECT snap_date, code FROM (SELECT m.date AS snap_date, b.code, row_number() OVER (PARTITION BY m.date ORDER BY sum(b.amount) DESC, b.code) AS rk
  FROM month_ends m JOIN bars b ON date_trunc('month', b.date) = date_trunc('month', m.date) GROUP BY m.date, b.code) t WHERE rk <= 15""",
    "snapshots": "SELECT snap_date, lead(snap_date) OVER (ORDER BY snap_date) AS next_snap FROM (SELECT DISTINCT snap_date FROM membership) t",
    "members": "SELECT d.date, d.pos, m.code FROM calendar d JOIN snapshots s ON s.snap_date <= d.date AND (d.date < s.next_snap OR s.next_snap IS NULL) JOIN membership m ON m.snap_date = s.snap_date",
    "annual_reports": """SELECT code, make_date(CAST(y AS INT), 12, 31) AS stat_date, make_date(CAST(y + 1 AS INT), 4, CAST(1 + ascii(substr(code, 9, 1)) % 28 AS INT)) AS pub_date, roe, capex
  FROM (SELECT code, year(date) AS y, avg(close/abs(pe_ttm))/avg(close)*4 AS roe, sum(volume) AS capex FROM bars WHERE pe_ttm IS NOT NULL GROUP BY code, year(date)) t""",
    "dividends": "SELECT code, date AS ex_date, turn/100.0*close AS dps FROM bars WHERE day(date) = 15 AND month(date) IN (3, 6)",
    "holders": """SELECT code, max(date) AS stat_date, CAST(max(date) + INTERVAL 30 DAY AS DATE) AS pub_date, CAST(sum(volume) AS BIGINT) AS holders
  FROM bars GROUP BY code, date_trunc('quarter', date)""",
    "industry": "SELECT DISTINCT code, CASE WHEN substr(code, 8, 2) = '05' THEN NULL ELSE substr(code, 4, 2) END AS bucket FROM bars",
    "index_series": "SELECT 'EW' AS series_id, date, avg(close) AS close FROM bars GROUP BY date",
    "fills": """SELECT user_id % 20 AS account, event_type AS code, CAST(ts AS DATE) AS date, event_id AS fill_id, CASE WHEN event_id % 3 = 0 THEN -100 ELSE 100 END * (1 + event_id % 5) AS shares,
  value AS price, greatest(5.0, 100 * (1 + event_id % 5) * value * 0.00025) AS fee FROM events""",
    "marks": "SELECT event_type AS code, CAST(ts AS DATE) AS date, avg(value) AS close FROM events GROUP BY event_type, CAST(ts AS DATE)",
    "predictions": "SELECT l.doc_id, 1/(1+exp(-(d.n_chars-500.0)/500.0)) AS p1, l.quality AS y FROM labels l JOIN documents d ON l.doc_id = d.doc_id",
    "two_source": "SELECT code, date, close AS close_a, CASE WHEN volume % 7 = 0 THEN close*1.01 ELSE close END AS close_b FROM bars",
    "supplier_days": "SELECT CAST(l_suppkey AS STRING) AS code, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice/l_quantity) AS open, max(l_extendedprice/l_quantity) AS high, sum(l_extendedprice)/sum(l_quantity) AS close FROM lineitem GROUP BY l_suppkey, CAST(l_shipdate AS DATE)",
    "listings": f"SELECT code, min(date) AS list_date, min_by(open, date)*{ISSUE} AS issue_price FROM supplier_days GROUP BY code",
}


def ctes(body: str, extra: dict[str, str] | None = None, given: tuple[str, ...] = ()) -> str:
    """`body` behind the WITH clause of every derived table that it names, directly or not, but for those given as tables."""
    known = VIEWS | (extra or {})
    order: list[str] = []

    def need(sql: str, own: str = "") -> None:
        for v in known:
            if v != own and v not in order and v not in given and re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql):
                need(known[v], v)
                order.append(v)

    need(body)
    return ("WITH " + ",\n".join(f"{v} AS ({known[v]})" for v in order) + "\n" if order else "") + body


_BARS: dict[tuple, str] = {}


class Tables:
    """The derived tables over the Parquet files of one folder, each a lazy DataFrame by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _spark_sql(self, text: str) -> DataFrame:
        return self.spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(BASE)})\b", rf"\1 parquet.`{self.sf_dir}/\2.parquet`", text))

    def _files(self, *names: str) -> tuple:
        """What tells the state of tables: number, bytes and a digest of the names, sizes and times of their files. Only listed, not read."""
        d = self.spark.read.format("binaryFile").load([f"{self.sf_dir}/{n}.parquet" for n in names])
        return tuple(d.agg(F.count("*"), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).first())

    def _bars(self) -> str:
        """Path of `bars`, written once for each application and state of the tables it is made of: all other panel tables read it and not the facts."""
        own = (self.spark.sparkContext.applicationId, self.sf_dir, *self._files("lineitem", "part"))
        if own not in _BARS:
            path = fresh_path(self.spark, "bars")
            self._spark_sql(ctes("SELECT * FROM bars")).repartition("code", F.year("date")).sortWithinPartitions("code", "date").write.parquet(path)
            _BARS[own] = path
        return _BARS[own]

    def sql(self, body: str, extra: dict[str, str] | None = None) -> DataFrame:
        text = ctes(body, extra, given=("bars",))
        if re.search(r"\b(?:FROM|JOIN)\s+bars\b", text):
            path = self._bars()
            text = re.sub(r"\b(FROM|JOIN)\s+bars\b(?:\s+([a-z]\w*))?", lambda m: f"{m[1]} parquet.`{path}` {m[2] or 'bars'}", text)  # keywords are in capitals, so a small word is an alias
        return self._spark_sql(text)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)
