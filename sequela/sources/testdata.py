"""Registers derived from the driver's synthetic tables."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequela.config import StudyParams
from sequela.sources.registers import load_register

STUDY = StudyParams(
    begin=date(1998, 1, 1),
    end=date(1998, 12, 8),
    extract=date(1998, 12, 15),
    endpoint_groups={
        "any_a": ("ECONOMY", "SMALL", "PROMO"),
        "any_b": ("MEDIUM", "LARGE"),
    },
    endpoint_names=("any_a", "any_b", "ECONOMY", "STANDARD"),
    dose2_lookback_days=180,
)

PRODUCT_RULES = (("contains", "PB", "PB"), ("equals", "AZ", "AZ"))
PRODUCTS = ("AZ", "PB")

# odd steps, so that age says nothing about the product, which goes by the parity of the id
_AGE = "cast(14 + 5 * (({id} * 7) % 19) as int)"
_SEX = "case when ({id} div 2) % 2 = 0 then 'F' else 'M' end"


@dataclass(frozen=True)
class Registers:
    """Lazily built registers over one folder of parquet tables."""

    spark: SparkSession
    folder: str

    def _load(self, table: str, columns: dict[str, str], id_col: str) -> DataFrame:
        return load_register(self.spark, f"{self.folder}/{table}.parquet", columns, id_col)

    def cohort(self) -> DataFrame:
        people = self._load(
            "customer",
            {
                "person_id": "c_custkey",
                "nation": "c_nationkey",
                "sex": _SEX.format(id="c_custkey"),
                "age_year": _AGE.format(id="c_custkey"),
                "simd": "c_mktsegment",
                "n_risk_gps": "cast(c_custkey % 5 as int)",
                "n_tests_gp": "cast(c_custkey % 3 as int)",
                "weight": "0.5D + (c_custkey % 10) / 10.0D",
                "bmi": "15.0D + c_custkey % 38",
                "diag_chd": "cast(c_custkey % 11 = 0 as int)",
                "diag_stroke": "cast(c_custkey % 13 = 0 as int)",
            },
            "person_id",
        )
        nation = self._load("nation", {"nation": "n_nationkey", "zone": "n_regionkey"}, "nation")
        return people.join(nation, "nation").drop("nation")

    def vaccination_records(self) -> DataFrame:
        return self._load(
            "orders",
            {
                "person_id": "o_custkey",
                "occurrence_time": "o_orderdate",
                "rec_id": "o_orderkey",
                "type": (
                    "case when o_orderkey % 20 = 0 then 'UNK'"
                    " when (o_custkey + case when o_orderkey % 25 = 0 then 1 else 0 end) % 2 = 0"
                    " then 'PB' else 'AZ' end"
                ),
                "stage": "case o_orderstatus when 'O' then 0 when 'F' then 1 when 'P' then 2 end",
            },
            "person_id",
        )

    def consultations(self) -> DataFrame:
        lines = self._load(
            "lineitem",
            {
                "o_orderkey": "l_orderkey",
                "p_partkey": "l_partkey",
                "start_date": "cast(l_shipdate as date)",
                "flag": "l_returnflag",
            },
            "o_orderkey",
        ).filter(F.col("flag") == "R")
        orders = self._load(
            "orders", {"o_orderkey": "o_orderkey", "person_id": "o_custkey"}, "o_orderkey"
        )
        part = self._load("part", {"p_partkey": "p_partkey", "code": "p_type"}, "p_partkey")
        return (
            lines.join(orders, "o_orderkey")
            .join(part, "p_partkey")
            .select(
                "person_id",
                "start_date",
                "code",
                F.expr(_AGE.format(id="person_id")).alias("age"),
                F.expr(_SEX.format(id="person_id")).alias("sex"),
            )
        )

    def deaths(self) -> DataFrame:
        people = self._load(
            "customer",
            {
                "person_id": "c_custkey",
                "balance": "c_acctbal",
                "death_date": "date_add(DATE'1998-03-01', cast(c_custkey % 400 as int))",
            },
            "person_id",
        )
        return people.filter(F.col("balance") < 0).select("person_id", "death_date")

    def spells(self) -> DataFrame:
        return self._load(
            "orders",
            {
                "person_id": "o_custkey",
                "admission_date": "cast(o_orderdate as date)",
                "discharge_date": (
                    "case when o_orderkey % 10 = 0 then null else"
                    " date_add(cast(o_orderdate as date), cast(o_orderkey % 21 as int)) end"
                ),
                "emergency": "o_orderkey % 3 = 0",
            },
            "person_id",
        )

    def tests(self) -> DataFrame:
        rows = self._load(
            "orders",
            {
                "key": "o_orderkey",
                "person_id": "o_custkey",
                "specimen_date": "date_add(cast(o_orderdate as date), 3)",
                "result": "case when o_orderkey % 5 < 2 then 'POSITIVE' else 'NEGATIVE' end",
            },
            "person_id",
        )
        return rows.filter(F.col("key") % 4 == 1).drop("key")

    def household(self) -> DataFrame:
        return self._load(
            "customer",
            {
                "person_id": "c_custkey",
                "care_home": f"{_AGE.format(id='c_custkey')} >= 65 and c_custkey % 9 = 0",
            },
            "person_id",
        )
