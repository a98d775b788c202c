"""The retail star over the driver's tables, from raw rows to the analyst view, as frames.

Cleansed tables, dimensions, facts and the view are written once for a folder of source tables and a state of its files, and then read
by every query: the cost of cleansing is paid by the first that asks, and queries scan the columns that they use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import cleaning, modelling
from granary.sources import retail
from granary.sources.scratch import scratch

AS_OF, EARLIEST = "2002-01-01 00:00:00", "1995-01-01 00:00:00"
#: Prices of the driver's parts lie between 849 and 1100 or so.
BANDS = {"Budget": 920, "Mid": 970}
SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: What has been written, and where: by application, folder, state of its files, and name.
_written: dict[tuple[str, str, str, str], tuple[str, DataFrame]] = {}


def state(spark: SparkSession, sf_dir: str) -> str:
    """The names, sizes and times of the source tables' files: another state, another set of written tables."""
    jvm = spark.sparkContext._jvm
    seen = []
    for name in SOURCES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(path):
            seen += [f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(path)]
    return ";".join(sorted(seen))


class Star:
    """The tables of one folder.  Each attribute is written when first asked for, by whichever Star asks."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.as_of, self.earliest = F.lit(AS_OF).cast("timestamp"), F.lit(EARLIEST).cast("timestamp")
        self._state: str | None = None

    def raw(self, name: str) -> DataFrame:
        return retail.raw(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def written(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, from the shared folder; made and written if it is not there."""
        if self._state is None:
            self._state = state(self.spark, self.sf_dir)
        key = (self.spark.sparkContext.applicationId, self.sf_dir, self._state, name)
        if key not in _written or not self._exists(_written[key][0]):
            df, path = make(), scratch(self.spark, name)
            df.write.parquet(path)
            _written[key] = (path, self.spark.read.schema(df.schema).parquet(path))
        return _written[key][1]

    def _exists(self, path: str) -> bool:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(target)

    def _cleansed(self, name: str) -> tuple[DataFrame, DataFrame]:
        parents = {p: self.good(p) for p in cleaning.TABLES[name].parents.values()}
        return cleaning.cleanse(name, self.raw(name), self.as_of, self.earliest, **parents)

    def good(self, name: str) -> DataFrame:
        """A cleansed table."""
        return self.written(f"silver-{name}", lambda: self._cleansed(name)[0])

    def rejected(self, name: str) -> DataFrame:
        """The rows that a cleansed table has not, with reasons."""
        return self.written(f"quarantine-{name}", lambda: self._cleansed(name)[1])

    @property
    def first_customers(self) -> DataFrame:
        """The customers before any of them moved."""
        early = self.raw("customers").filter(F.col("updated_at") < self.earliest)
        return self.written("first-customers", lambda: cleaning.cleanse("customers", early, self.as_of)[0])

    @property
    def dates(self) -> DataFrame:
        return self.written("dim-date", lambda: modelling.date_spine(self.good("orders")))

    @property
    def first_dimension(self) -> DataFrame:
        empty = self.spark.createDataFrame([], modelling.CUSTOMER_SCHEMA)
        return self.written("dim-customer-first", lambda: modelling.next_customer_dimension(empty, self.first_customers))

    @property
    def customer_dimension(self) -> DataFrame:
        return self.written("dim-customer", lambda: modelling.next_customer_dimension(self.first_dimension, self.good("customers")))

    @property
    def product_dimension(self) -> DataFrame:
        return self.written("dim-product", lambda: modelling.product_dimension(self.good("products"), BANDS))

    @property
    def store_dimension(self) -> DataFrame:
        return self.written("dim-store", lambda: modelling.store_dimension(self.good("stores")))

    @property
    def fact(self) -> DataFrame:
        return self.written("fact-sales", lambda: modelling.fact_sales(self.good("order_items"), self.good("orders"), self.customer_dimension))

    @property
    def view(self) -> DataFrame:
        return self.written(
            "analyst-view",
            lambda: modelling.analyst_view(self.fact, self.dates, self.customer_dimension, self.product_dimension, self.store_dimension)
        )

    @property
    def tables(self) -> dict[str, DataFrame]:
        """Cleansed tables and the star, by the names that checks and the catalogue use."""
        silver = {("orders_" if t == "orders" else t): self.good(t) for t in ("customers", "products", "stores", "orders")}
        gold = {
            "dim_date": self.dates, "dim_customer": self.customer_dimension, "dim_product": self.product_dimension, "dim_store": self.store_dimension,
            "fact": self.fact
        }
        return {**silver, "items": self.good("order_items"), **gold}


