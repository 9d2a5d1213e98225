"""A fact view over the sample tables (lineitem, supplier, nation, orders).

A line item is a report; its measuring point is (supplier, part modulo 4). Each order
divisible by 50 reports twice, which gives exact duplicates. Supplier and nation place
a point in a basin, sector and region, and the order names the reporter; where one of
them is unknown these columns are NULL.

Each table is reduced to one row per key before it joins: keys are unique in the
samples, which a test asserts; a repeated key would be merged. Knowing the key unique,
Spark drops the left join from every plan that reads none of its columns: only builds
that read reporters join the orders, and distinct measurements join nothing. The orders
join first, so that their shuffle moves line items without the columns of places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from acequia import schema as S


def _unless(missing: Column, value: Column) -> Column:
    return F.when(~missing, value)


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """What depends on the supplier alone, one row per supplier."""
    supplier = spark.read.parquet(f"{folder}/supplier.parquet")
    s, code = F.col("s_suppkey"), F.lit(100) + F.col("nation")
    no_basin = s % 17 == 16
    no_sub = no_basin | (s % 3 == 2)
    no_sector, no_board = s % 5 == 4, s % 7 > 3
    return supplier.groupBy("s_suppkey").agg(F.max("s_nationkey").alias("nation")).select(
        "s_suppkey", "nation",
        _unless(no_basin, code.cast("int")).alias("COD_CUENCA"),
        _unless(no_sub, (code * 100 + s % 3).cast("int")).alias("COD_SUBCUENCA"),
        _unless(no_sector, (F.lit(120) + s % 5).cast("int")).alias("COD_SECTOR_SHA"),
        _unless(no_sector, F.concat(F.lit("Sector "), (s % 5).cast("string"))).alias("SECTOR_SHA"),
        _unless(no_board, (s % 7).cast("double")).alias("ID_JUNTA"),
        _unless(no_board, (s % 2).cast("int")).alias("REPRESENTA_JUNTA"),
    )


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{folder}/{name}.parquet")

    nation = table("nation").groupBy("n_nationkey").agg(
        F.max("n_name").alias("name"), F.max("n_regionkey").alias("region")
    )
    orders = table("orders").repartition("o_orderkey").groupBy("o_orderkey").agg(
        F.max("o_custkey").alias("customer"),
        F.max(F.col("o_orderpriority") == "5-LOW").alias("anonymous"),
    )
    return (
        table("lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(_places(spark, folder), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(nation, F.col("nation") == F.col("n_nationkey"), "left")
    )


def sample_fact(spark: SparkSession, folder: str) -> DataFrame:
    key, s, k = F.col("l_orderkey"), F.col("l_suppkey"), F.col("l_partkey") % 4
    name, sub, who = F.col("name"), (s % 3).cast("string"), F.col("customer") % 10
    no_basin, no_sub = F.col("COD_CUENCA").isNull(), F.col("COD_SUBCUENCA").isNull()
    no_subsub = no_sub | (k == 3)
    no_right = s % 4 == 3
    spelling = F.when(key % 991 == 0, " (alt)").otherwise("")
    columns = {
        "UTM_NORTE": _unless(key % 997 == 0, (F.lit(6000000) + s * 100).cast("int")),
        "UTM_ESTE": (F.lit(300000) + k * 1000).cast("int"),
        "HUSO": (F.lit(18) + s % 2).cast("int"),
        "REGION": (F.col("region") + 1).cast("int"),
        "PROVINCIA": name,
        "COMUNA": F.concat(name, F.lit("-"), sub),
        "NOM_CUENCA": _unless(no_basin, name),
        "NOM_SUBCUENCA": _unless(no_sub, F.concat(name, F.lit(" sub "), sub)),
        "COD_SUBSUBCUENCA": _unless(no_subsub, (F.col("COD_SUBCUENCA") * 10 + k).cast("int")),
        "NOM_SUBSUBCUENCA": _unless(no_subsub, F.concat(name, F.lit(" subsub "), k.cast("string"), spelling)),
        "CODIGO": F.concat(F.lit("OB-"), s.cast("string"), F.lit("-"), k.cast("string")),
        "NATURALEZA": F.when(k < 2, 1).otherwise(2),
        "APR": _unless(k == 2, (s % 2).cast("int")),
        "PARTE_JUNTA": _unless(F.col("ID_JUNTA").isNull(), (k % 2).cast("int")),
        "CANAL_TRANSMISION": (s % 4).cast("int"),
        "TIPO_DERECHO": F.when(s % 4 == 0, 1).when(s % 4 == 1, 2).when(s % 4 == 2, 99),
        "VOLUMEN_ANUAL": _unless(no_right, (s * 1000 + k * 10).cast("double")),
        **{
            c: _unless(no_right, (s + k).cast("double") + F.lit(0.5 * i))
            for i, c in enumerate(S.MONTHLY_FLOWS)
        },
        "CAUDAL": _unless(F.col("l_linenumber") == 7, F.col("l_quantity")),
        "ALTURA_LIMNIMETRICA": F.when(F.col("l_returnflag") == "R", F.col("l_tax") * 100),
        "NIVEL_FREATICO": F.when(k < 2, F.col("l_discount") * 100),
        "TOTALIZADOR": F.floor("l_extendedprice").cast("bigint"),
        "FECHA_MEDICION": _unless(key % 499 == 0, F.col("l_shipdate")),
        "INF": _unless(F.col("anonymous"), who.cast("int")),
        "NOMB_INF": _unless(who == 0, F.concat(F.lit("Inf"), who.cast("string"))),
        "A_PAT_INF": F.when(who == 0, "  ").when(who.isNotNull(), " Perez "),
        "A_MAT_INF": F.when(who >= 5, "Soto"),
    }
    twice = F.when(key % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return _reports(spark, folder).select("*", F.explode(twice)).select(
        *(columns.get(c, F.col(c)).alias(c) for c in S.FACT.names)
    )
