"""Files of one symbol each as a Spark data source: ``spark.read.format("symbol_files")``.

A folder holds a folder for each entity, and in it one file or one ``symbol=...`` folder for each symbol: CSV for
price series (``ohlcv/d``, ``ohlcv/w``, ``ohlcv/m``), JSON lines for other entities.  Each symbol is a partition
of the scan.  Filters on ``symbol`` choose partitions before any task starts; filters on ``date`` are pushed to
the reader, which gives no other rows.  The schema follows from the entity.

Options: ``path``; ``entity`` (ohlcv); ``interval`` (1d, 1wk or 1mo: weeks and months come from their own files,
else from the days'); ``symbols`` (names with commas between); ``errors``: ``fail``, or ``skip`` to go on without
symbols that have no data.
"""

from __future__ import annotations

import datetime
import io
import urllib.parse
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.json
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

NAME = "symbol_files"
#: Columns of each entity, without the symbol.
ENTITIES = {
    "ohlcv": "date date, open double, high double, low double, close double, volume double",
    "profile": "name string, sector string, industry string, exchange string, country string, currency string, market_cap_usd double, avg_daily_volume_3m double",
    "financials": "free_cash_flow_ttm double, total_revenue_ttm double, fiscal_year_end date, as_of date",
    "analyst": "price_target_mean double, price_target_median double, price_target_high double, price_target_low double, n_analysts int, buy_count int, hold_count int, sell_count int, strong_buy_count int, strong_sell_count int, recommendation_mean double, as_of date",
    "rating_changes": "date date, action string, from_grade string, to_grade string, firm string",
    "upcoming_earnings": "date date, eps_estimate double, eps_actual double, when string",
    "earnings_history": "date date, eps_estimate double, eps_actual double, eps_surprise_pct double, revenue_estimate double, revenue_actual double",
    "upcoming_ex_dividend": "date date, amount double",
}
INTERVALS = {"1d": "d", "1wk": "w", "1mo": "m"}
_ARROW = {"date": pa.date32(), "double": pa.float64(), "string": pa.string(), "int": pa.int32()}


class NotSupported(Exception):
    """A source doesn't know an entity."""


class NoData(Exception):
    """A source knows an entity but has nothing for a symbol."""


def schema_of(entity: str) -> str:
    if entity not in ENTITIES:
        raise ValueError(f"unknown entity: {entity!r}")
    return f"symbol string, {ENTITIES[entity]}"


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if ":/" in path else (pyarrow.fs.LocalFileSystem(), path)


def _listed(path: str) -> list[pyarrow.fs.FileInfo]:
    store, where = _store(path)
    return [f for f in store.get_file_info(pyarrow.fs.FileSelector(where, allow_not_found=True)) if not f.base_name.startswith(("_", "."))]


def supports(path: str, entity: str) -> bool:
    """Whether a folder has an entity's files; ValueError for a name that is no entity."""
    schema_of(entity)
    return bool(_listed(f"{path}/{entity}"))


@dataclass
class Symbol(InputPartition):
    """One symbol's place in a scan."""

    symbol: str
    place: str
    resample: str | None


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.entity = options["path"].rstrip("/"), options.get("entity", "ohlcv")
        self.columns = [c.split() for c in ENTITIES[self.entity].split(", ")]
        self.only = {s.strip() for s in options["symbols"].split(",") if s.strip()} if "symbols" in options else None
        self.interval, self.skip = options.get("interval", "1d"), options.get("errors", "fail") == "skip"
        if self.interval not in INTERVALS:
            raise ValueError(f"unsupported interval: {self.interval!r}")
        self.least = self.most = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what bounds the date or names symbols; the rest is left to Spark."""
        dated = any(name == "date" for name, _ in self.columns)
        day = datetime.timedelta(days=1)
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("symbol",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = own if self.only is None else self.only & own
            elif name == ("date",) and dated and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = f.value + day if isinstance(f, GreaterThan) else f.value
                    self.least = low if self.least is None else max(self.least, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = f.value - day if isinstance(f, LessThan) else f.value
                    self.most = high if self.most is None else min(self.most, high)
            else:
                yield f

    def partitions(self) -> list[Symbol]:
        place, resample = f"{self.path}/{self.entity}", None
        if self.entity == "ohlcv":
            code = INTERVALS[self.interval]
            resample = None if code == "d" or _listed(f"{place}/{code}") else code
            place = f"{place}/{'d' if resample else code}"
        found = _listed(place)
        if not found:
            raise NotSupported(f"no {self.entity} in {self.path}")
        names = {f.base_name: urllib.parse.unquote(f.base_name.removeprefix("symbol=") if f.type == pyarrow.fs.FileType.Directory else f.base_name.rpartition(".")[0]) for f in found}
        out = [Symbol(s, f"{place}/{name}", resample) for name, s in sorted(names.items()) if self.only is None or s in self.only]
        return out or [Symbol("", "", None)]

    def read(self, part: Symbol) -> Iterator[pa.RecordBatch]:
        if not part.place:
            return
        store, where = _store(part.place)
        info = store.get_file_info(where)
        files = sorted(f.path for f in _listed(part.place) if f.size) if info.type == pyarrow.fs.FileType.Directory else [where]
        tables = []
        for name in files:
            with store.open_input_stream(name) as file:
                data = file.read()
            table = self.parsed(data)
            if table is None:
                if not self.skip:
                    raise NoData(f"no data for {part.symbol} in {name}")
            else:
                tables.append(table)
        if not tables:
            return
        table = pa.concat_tables(tables)
        if part.resample:
            table = _resampled(table, part.resample)
        for bound, keep in ((self.least, pc.greater_equal), (self.most, pc.less_equal)):
            if bound is not None:
                table = table.filter(keep(table["date"], pa.scalar(bound, pa.date32())))
        if "date" in table.column_names:
            table = table.sort_by("date")
        table = table.add_column(0, "symbol", pa.array([part.symbol] * len(table), pa.string()))
        yield from table.to_batches()

    def parsed(self, data: bytes) -> pa.Table | None:
        """A file's rows with the entity's columns, whatever their case; columns that it lacks are null.  None where it has no data."""
        head = data.lstrip().split(b"\n", 1)[0]
        if not head or b"No data" in head:
            return None
        kinds = {name: _ARROW[kind] for name, kind in self.columns}
        if self.entity == "ohlcv":
            names = [n.strip().decode() for n in head.rstrip(b"\r").split(b",")]
            if "date" not in map(str.lower, names):
                return None
            options = pyarrow.csv.ConvertOptions(column_types={n: kinds[n.lower()] for n in names if n.lower() in kinds})
            table = pyarrow.csv.read_csv(io.BytesIO(data), convert_options=options)
        else:
            options = pyarrow.json.ParseOptions(explicit_schema=pa.schema(list(kinds.items())), unexpected_field_behavior="ignore")
            table = pyarrow.json.read_json(io.BytesIO(data), parse_options=options)
        by_name = {n.lower(): n for n in table.column_names}
        table = pa.table([table[by_name[n]].cast(k) if n in by_name else pa.nulls(len(table), k) for n, k in kinds.items()], names=list(kinds))
        table = table.filter(pc.is_valid(table["date"])) if self.entity == "ohlcv" else table
        return table if len(table) else None


def _resampled(days: pa.Table, code: str) -> pa.Table:
    """Weeks that end on Fridays, or months named by their last day, from a symbol's days."""
    days = days.sort_by("date")
    first = pc.add(days["date"].cast(pa.int32()), 0)
    if code == "w":
        end = pc.add(first, pc.subtract(6, _mod(pc.add(first, 5), 7))).cast(pa.int32()).cast(pa.date32())  # day 1 is a Friday
    else:
        end = pc.subtract(pc.ceil_temporal(days["date"], 1, "month", ceil_is_strictly_greater=True).cast(pa.date32()).cast(pa.int32()), 1).cast(pa.int32()).cast(pa.date32())
    grouped = days.set_column(0, "date", end).group_by("date", use_threads=False).aggregate([("open", "first"), ("high", "max"), ("low", "min"), ("close", "last"), ("volume", "sum")])
    return grouped.rename_columns([n.partition("_")[0] for n in grouped.column_names]).select(days.column_names)


def _mod(x, n: int):
    return pc.subtract(x, pc.multiply(pc.floor(pc.divide(x.cast(pa.float64()), float(n))).cast(pa.int32()), n))


class SymbolFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return schema_of(self.options.get("entity", "ohlcv"))

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SymbolFiles)


def scan(spark: SparkSession, path: str, entity: str = "ohlcv", **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(NAME).option("path", path).option("entity", entity).options(**options).load()


def write_series(bars: DataFrame, path: str, interval: str = "1d") -> None:
    """Bars as one CSV file a symbol, in the layout that the format reads; the files of these symbols are replaced."""
    rows = bars.select("symbol", *[F.col(c).alias(c.capitalize()) for c in ("date", "open", "high", "low", "close", "volume")])
    own = rows.repartition("symbol").sortWithinPartitions("symbol", "Date").write.partitionBy("symbol").mode("overwrite")
    own.option("partitionOverwriteMode", "dynamic").csv(f"{path}/ohlcv/{INTERVALS[interval]}", header=True)
