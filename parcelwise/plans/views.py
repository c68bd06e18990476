"""The five analytical views of a set of tables, built lazily from one order-level fact."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from parcelwise.plans import rollups
from parcelwise.plans.order_metrics import order_metrics
from parcelwise.sources import catalog
from parcelwise.sources.scratch import store
from parcelwise.sources.tables import Tables, publish, register, remove_folder, replace_folders

# Names under which SQL and dashboards read the views.
VIEW_NAMES = {
    "order_metrics": "vw_order_delivery_metrics",
    "reliability_summary": "vw_delivery_reliability_summary",
    "monthly_performance": "vw_monthly_sales_performance",
    "state_performance": "vw_state_delivery_performance",
    "category_performance": "vw_category_delivery_performance",
}


def _by_time(attribute: str, df: DataFrame) -> DataFrame:
    """The fact in order of purchase, so that readers of some months skip the other files and row groups by their statistics.

    Orders of one moment are cut by their id, so no file grows with them.
    """
    if attribute != "order_metrics":
        return df
    columns = [c for c in ("order_purchase_timestamp", "order_id") if c in df.columns]
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns) if columns else df


class Views:
    """Views over ``tables``; those in ``given`` are taken from there instead of computed."""

    def __init__(self, tables: Tables, given: Mapping[str, DataFrame] | None = None) -> None:
        self.tables = tables
        self._frames = dict(given or {})
        self._given = frozenset(self._frames)
        unknown = self._given - VIEW_NAMES.keys()
        if unknown:
            raise ValueError(f"no such views: {sorted(unknown)}")

    def is_given(self, attribute: str) -> bool:
        """Whether a view was handed over, and so costs no joins to read again."""
        return attribute in self._given

    def _view(self, attribute: str, build: Callable[[], DataFrame]) -> DataFrame:
        if attribute not in self._frames:
            self._frames[attribute] = build()
        return self._frames[attribute]

    @property
    def order_metrics(self) -> DataFrame:
        return self._view("order_metrics", lambda: order_metrics(self.tables))

    @property
    def reliability_summary(self) -> DataFrame:
        return self._view("reliability_summary", lambda: rollups.reliability_summary(self.order_metrics))

    @property
    def monthly_performance(self) -> DataFrame:
        return self._view("monthly_performance", lambda: rollups.monthly_performance(self.order_metrics))

    @property
    def state_performance(self) -> DataFrame:
        return self._view("state_performance", lambda: rollups.state_performance(self.order_metrics))

    @property
    def category_performance(self) -> DataFrame:
        return self._view(
            "category_performance", lambda: rollups.category_performance(self.tables, self.order_metrics)
        )

    def frames(self) -> dict[str, DataFrame]:
        return {name: getattr(self, attribute) for attribute, name in VIEW_NAMES.items()}

    def stored(self) -> Views:
        """The same views on a fact written once: each finding then reads a few columns of it."""
        return Views(self.tables, {"order_metrics": store(self.order_metrics, "order_metrics")})

    def register(self, prefix: str = "") -> None:
        """Makes the raw tables and the views readable by name from Spark SQL.

        Session views of the same names are replaced, as when a view is published again; ``prefix`` keeps
        them apart from names such as ``orders`` that a session may use itself.
        """
        named = {**dict(self.tables.items()), **self.frames()}
        register({prefix + name: df for name, df in named.items()})

    def save(self, database: str) -> Views:
        """Puts the views into a catalog database beside the tables, and returns them as read from there.

        As with :meth:`publish` the fact is computed once, and given views are written as they are.
        """
        attributes = {name: attribute for attribute, name in VIEW_NAMES.items()}

        def frame(name: str, written: dict[str, DataFrame]) -> DataFrame:
            known = self._frames | {attributes[n]: df for n, df in written.items()}
            return _by_time(attributes[name], getattr(Views(self.tables, known), attributes[name]))

        saved = catalog.save(self.tables.orders.sparkSession, database, "views", attributes, frame)
        return Views(self.tables, {attributes[name]: df for name, df in saved.items()})

    def publish(self, folder: str) -> Views:
        """Writes the views as Parquet for any reader, the fact in order of purchase, and returns them as read from there.

        Views that were given or computed before are written as they are. Of the others, the fact is computed
        once and the rollups are built from what was written. All are written beside the folder first and moved
        there together, so views read from the same folder can be published into it.
        """
        spark = self.tables.orders.sparkSession
        staged = f"{folder.rstrip('/')}.staged-{uuid.uuid4().hex}"
        views, schemas = dict(self._frames), {}
        try:
            for attribute, name in VIEW_NAMES.items():
                df = _by_time(attribute, getattr(Views(self.tables, views), attribute))
                publish({name: df}, staged)
                schemas[attribute] = df.schema
                views[attribute] = spark.read.schema(df.schema).parquet(f"{staged}/{name}")
        except Exception:
            remove_folder(spark, staged)
            raise
        replace_folders(spark, staged, folder, VIEW_NAMES.values())
        return Views(
            self.tables,
            {a: spark.read.schema(schemas[a]).parquet(f"{folder}/{name}") for a, name in VIEW_NAMES.items()},
        )
