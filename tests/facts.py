"""Small hand-made fact tables."""

from datetime import datetime

from acequia import schema as S

_DEFAULT = {
    "UTM_NORTE": 6300000, "UTM_ESTE": 350000, "HUSO": 19, "REGION": 1,
    "PROVINCIA": "P", "COMUNA": "C",
    "COD_CUENCA": 101, "NOM_CUENCA": "Rio", "COD_SUBCUENCA": 10101, "NOM_SUBCUENCA": "Rio alto",
    "COD_SUBSUBCUENCA": 101011, "NOM_SUBSUBCUENCA": "Rio alto uno",
    "CODIGO": "OB-1", "NATURALEZA": 2, "CANAL_TRANSMISION": 1,
    "FECHA_MEDICION": datetime(2023, 6, 15, 10, 30),
}


def fact(spark, *rows):
    """One fact row per dict; columns not given take a default or NULL."""
    unknown = {c for r in rows for c in r} - set(S.FACT.names)
    assert not unknown, unknown
    data = [tuple({**_DEFAULT, **r}.get(c) for c in S.FACT.names) for r in rows]
    return spark.createDataFrame(data, S.FACT)


def dicts(df):
    return [r.asDict() for r in df.collect()]
