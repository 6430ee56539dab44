"""Canonical tables built from one folder of test tables."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.functions import quantities as qty
from cadenza.operators import (cleaning, entity_features, feature_matrix,
                               joining, ranking, visits)
from cadenza.session import remove_files, write_and_read
from cadenza.sources import extracts, testbed


class Tables:
    """Lazy plans, and stage tables for what several consumers share.

    ``main`` and ``visit_dataset`` are plans.  ``main_stage``,
    ``matrix_stage`` and ``dataset_stage`` write the table once to the shared
    folder and read it back, so a job with several branches over the main
    table builds it once and each branch reads only its own columns.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._stages: dict[str, DataFrame] = {}

    def _stage(self, name: str, build) -> DataFrame:
        if name not in self._stages:
            self._stages[name] = write_and_read(build(), name)
        return self._stages[name]

    def drop_stages(self) -> None:
        """Remove the stage tables at the end of a job.

        Results that read them must have been written before.
        """
        for df in self._stages.values():
            remove_files(df)
        self._stages.clear()

    def main_stage(self) -> DataFrame:
        """The main table; what only its plan reads goes when it is written."""
        if "main-table" not in self._stages:
            early = []

            def stage(df: DataFrame, name: str) -> DataFrame:
                early.append(write_and_read(df, name))
                return early[-1]
            self._stage("main-table", lambda: self.main(stage))
            for df in early:
                remove_files(df)
        return self._stages["main-table"]

    def matrix_stage(self) -> DataFrame:
        return self._stage("feature-matrix", self.matrix)

    def dataset_stage(self) -> DataFrame:
        return self._stage("training-set", self.visit_dataset)

    def matrix(self) -> DataFrame:
        return feature_matrix.feature_matrix(
            self.main_stage(), testbed.REFERENCE_DATE, stage=write_and_read)

    def raw_invoices(self) -> DataFrame:
        return extracts.name_invoices(
            testbed.raw_invoices(self.spark, self.sf_dir))

    def raw_lines(self) -> DataFrame:
        return extracts.name_lines(testbed.raw_lines(self.spark, self.sf_dir))

    def raw_source_lines(self) -> DataFrame:
        """Lines with the column names of the delivered files."""
        return testbed.raw_lines(self.spark, self.sf_dir)

    def raw_clients(self) -> DataFrame:
        return extracts.name_clients(
            testbed.raw_clients(self.spark, self.sf_dir))

    def invoices(self) -> DataFrame:
        return cleaning.clean_invoices(self.raw_invoices())

    def lines(self, stage=write_and_read) -> DataFrame:
        return cleaning.clean_lines(self.raw_lines(), stage=stage)

    def clients(self) -> DataFrame:
        return cleaning.clean_clients(self.raw_clients())

    def main(self, stage=write_and_read) -> DataFrame:
        return joining.main_table(self.lines(stage), self.invoices(),
                                  self.clients())

    def visit_dataset(self, bought: bool = False) -> DataFrame:
        return visits.visit_dataset(self.main_stage(), bought=bought)

    def bought_rows(self) -> DataFrame:
        """The bought rows: from the training set if it is written, else
        built without the others."""
        if "training-set" in self._stages:
            return visits.positives(self.dataset_stage())
        return visits.positives(self.visit_dataset(bought=True))

    def latest_dataset(self) -> DataFrame:
        return visits.latest_dataset(self.main_stage(), write_and_read)

    def scored(self) -> DataFrame:
        """Latest snapshots with a deterministic probability and quantity.

        The reorder rate replaces the classifier and a blend of median and
        last quantity the regressor (absent for some rows), so every later
        step can be recomputed by another engine.
        """
        rows = ranking.latest_with_rate(self.latest_dataset())
        products = write_and_read(entity_features.product_profile(
            self.main_stage(), testbed.REFERENCE_DATE).select(
            "code_article", "is_new_product"), "new-products")
        blend = F.col("median_qty") * 0.75 + F.col("last_qty") * 0.25
        return (rows.join(products, "code_article", "left")
                .withColumn("is_new_product", F.coalesce(
                    "is_new_product", F.lit(False)))
                .withColumn("regressor_qty", F.when(
                    F.col("frequency") % 5 != 0, qty.served_quantity(blend))))
