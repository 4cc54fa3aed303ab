"""Input tables of the analyses derived from the generated star-schema tables.

The adapter only renames, re-times and re-types: every row of a derived table
comes from a row (or group) of the given tables, so it grows with them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hygroflow.functions import clock

ORIGIN = "2024-01-01"
SQUEEZE = 6  # 30 days of events are packed into five so that minutes are dense
FLOOR = "2024-01-02"


@dataclass(frozen=True)
class Testbed:
    """Derived tables over one folder of parquet files."""

    spark: SparkSession
    folder: str

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @staticmethod
    def _packed_micros(ts: Column) -> Column:
        origin = clock.micros(F.lit(ORIGIN).cast("timestamp_ntz"))
        return origin + F.floor((clock.micros(ts) - origin) / F.lit(SQUEEZE)).cast("long")

    def sensor_data(self) -> DataFrame:
        code = F.col("event_id") % 4
        rh = F.round(F.lit(20.0) + F.col("value") % 85, 2)
        temp = F.round(F.col("value") % 60 - 2, 2)
        return self._read("events").select(
            clock.from_micros(self._packed_micros(F.col("ts"))).cast("string").alias("measure_date"),
            F.when(F.col("event_id") % 53 == 0, F.lit("199"))  # a device that no analysis knows
            .otherwise((code + 101).cast("string"))
            .alias("sensor_id"),
            F.when(F.col("event_id") % 97 == 0, F.lit("ERR"))
            .when(code.isin(0, 2), rh.cast("string"))
            .otherwise(temp.cast("string"))
            .alias("data_value"),
        )

    def actuator_measure(self) -> DataFrame:
        """Every event; some belong to another actuator, some have an unreadable time."""
        whole_second = F.floor(self._packed_micros(F.col("ts")) / F.lit(1_000_000)) * 1_000_000
        return (
            self._read("events")
            .select(
                F.when(F.col("event_id") % 101 == 0, F.lit("bad text"))
                .otherwise(clock.from_micros(whole_second).cast("string"))
                .alias("start_time"),
                F.floor("value").cast("int").cast("string").alias("execution_time"),
                (F.col("user_id") % 4).cast("string").alias("state"),
                F.when(F.col("event_id") % 5 == 4, F.lit("2")).otherwise(F.lit("1")).alias("actuator_id"),
            )
        )

    def calendar_executions(self) -> DataFrame:
        return self._read("orders").select(
            F.col("o_orderkey").alias("execution_id"),
            F.col("o_orderdate").cast("string").alias("start_time"),
            F.floor("o_totalprice").cast("long").alias("execution_time"),
            F.lit("ON").alias("code_on"),
            F.lit("OFF").alias("code_off"),
            F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(0)).cast("long").alias("executed"),
        )

    def schedule(self) -> DataFrame:
        return self._read("orders").select(
            F.col("o_orderkey").alias("schedule_id"),
            F.floor("o_totalprice").cast("long").alias("execution_time"),
        )

    def schedule_data(self) -> DataFrame:
        """The latest line of every order."""
        return (
            self._read("lineitem")
            .groupBy(F.col("l_orderkey").alias("schedule_id"))
            .agg(F.max("l_shipdate").cast("string").alias("last_execution"))
        )

    def all_executions(self) -> DataFrame:
        """Executions already synced: those with an even key, from both sources."""
        calendar = (
            self._read("orders")
            .where(F.col("o_orderkey") % 2 == 0)
            .select(
                F.concat(F.lit("c-"), F.col("o_orderkey")).alias("execution_id"),
                F.lit("calendar").alias("_source"),
                F.col("o_orderdate").alias("start_time"),
                F.floor("o_totalprice").cast("long").alias("runtime"),
            )
        )
        schedule = (
            self.schedule_data()
            .where(F.col("schedule_id") % 2 == 0)
            .join(self.schedule(), "schedule_id")
            .select(
                F.concat(F.lit("s-"), F.col("schedule_id")).alias("execution_id"),
                F.lit("schedule").alias("_source"),
                F.col("last_execution").cast("timestamp_ntz").alias("start_time"),
                F.col("execution_time").alias("runtime"),
            )
        )
        return calendar.unionByName(schedule)

    def weather_payload(self) -> DataFrame:
        """One landed payload per day: parallel arrays with a slot for every hour."""
        hourly = self._read("events").groupBy(
            F.col("ts").cast("date").alias("day"), F.hour("ts").alias("hour")
        ).agg(
            F.avg("value").alias("mean_value"),
            F.avg(F.col("value") % 100).alias("mean_rest"),
            F.min("value").alias("min_value"),
            F.max("value").alias("max_value"),
            F.avg(F.col("value") % 20).alias("mean_wind"),
        )
        by_hour = F.map_from_entries(
            F.collect_list(
                F.struct(
                    "hour",
                    F.struct("mean_value", "mean_rest", "min_value", "max_value", "mean_wind"),
                )
            )
        )
        day_start = F.col("day").cast("timestamp_ntz")

        def slots(field: str) -> Column:
            return F.transform(
                F.sequence(F.lit(0), F.lit(23)),
                lambda h: F.try_element_at(F.col("m"), h).getField(field),
            )

        return (
            hourly.groupBy("day")
            .agg(by_hour.alias("m"))
            .select(
                day_start.alias("start"),
                (day_start + F.expr("INTERVAL '1' DAY")).alias("end"),
                F.lit(3600).alias("step_s"),
                slots("mean_value").alias("temperature_2m"),
                slots("mean_rest").alias("relative_humidity_2m"),
                slots("min_value").alias("rain"),
                slots("max_value").alias("surface_pressure"),
                slots("mean_wind").alias("wind_speed_10m"),
            )
        )

    def customs(self) -> DataFrame:
        price = F.when(F.col("p_partkey") % 50 == 0, F.lit("n/a")).otherwise(
            F.col("p_retailprice").cast("string")
        )
        return self._read("part").select(
            F.col("p_name").alias("C112 DESCRIPCION"),
            F.col("p_type").alias("C115 COD. PAS ORIGEN"),
            F.col("p_brand").alias("C68 CD. TIPO CARGA"),
            F.concat_ws(" ", "p_type", "p_brand").alias("C53 CD. TIPO DATOS"),
            price.alias("C72 VALOR TOTAL FOB U$"),
            (F.col("p_size") % 2 + 6).alias("C49 RGIMEN ADUANERO"),
            F.col("p_name").alias("C106 COD. CLASE EMBALAJE"),
        )

    def faulty_payload(self) -> DataFrame:
        """The landed payloads; every third day has two values too many, every seventh no time step."""
        payload = self.weather_payload()
        fields = ["temperature_2m", "relative_humidity_2m", "rain", "surface_pressure", "wind_speed_10m"]
        day = F.day("start")
        more = {
            c: F.when(day % 3 == 0, F.concat(F.col(c), F.array(F.array_max(F.col(c)), F.lit(None)))).otherwise(F.col(c))
            for c in fields
        }
        return payload.withColumns(more).withColumn("step_s", F.when(day % 7 == 0, 0).otherwise(F.col("step_s")))

    def _lots(self) -> DataFrame:
        """Parts with the word of their lot of ten, whose letters change fastest at the front."""
        digits = F.lpad(F.floor(F.col("p_partkey") / 10).cast("string"), 6, "0")
        return self._read("part").withColumn("lot", F.translate(F.reverse(digits), "0123456789", "abcdefghij"))

    def names_a(self, plain: bool = False) -> DataFrame:
        """Names of lots and, on request, the plain names of the parts as well."""
        company = F.concat_ws(" ", "lot", "p_name", F.lit("Inc."))
        rows = self._lots().select(company.alias("company"))
        if plain:
            rows = rows.unionByName(self._read("part").select(F.concat("p_name", F.lit(" Inc.")).alias("company")))
        return rows.distinct()

    def names_b(self, plain: bool = False) -> DataFrame:
        """Spellings with the brand appended, and plural forms that share acronyms; plain ones as in ``names_a``."""
        lots = self._lots()

        def spelled(name: Column) -> DataFrame:
            branded = F.concat(F.upper(name), F.lit(" & "), "p_brand", F.lit(" GmbH"))
            plural = F.concat(name, F.lit("s Ltd."))
            return lots.select(branded.alias("company")).unionByName(lots.select(plural.alias("company")))

        rows = spelled(F.concat_ws(" ", "lot", "p_name"))
        return (rows.unionByName(spelled(F.col("p_name"))) if plain else rows).distinct()
