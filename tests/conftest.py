import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from bankrec import schema  # noqa: E402
from bankrec.session import build_session, ensure_checkpoint_dir  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", 4, **{"spark.ui.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(session)
    yield session
    session.stop()


def money(v):
    return None if v is None else Decimal(str(v)).quantize(Decimal("0.01"))


def _frame(spark, rows, struct):
    """Rows are dicts; missing columns are null and ``chave`` is computed."""
    from pyspark.sql import functions as F
    from bankrec.functions.text import company_key
    kinds = {f.name: f.dataType for f in struct.fields}
    data = [tuple(money(r.get(n)) if kinds[n] == schema.MONEY else r.get(n) for n in kinds) for r in rows]
    df = spark.createDataFrame(data, struct)
    for name in ("empresa", "entidade"):
        if name in kinds and "chave" in kinds:
            df = df.withColumn("chave", F.coalesce("chave", company_key(name)))
    return df


@pytest.fixture(scope="session")
def movimentos(spark):
    return lambda rows: _frame(spark, rows, schema.MOVIMENTOS)


@pytest.fixture(scope="session")
def linhas(spark):
    return lambda rows: _frame(spark, rows, schema.LINHAS)


@pytest.fixture(scope="session")
def saldos(spark):
    return lambda rows: _frame(spark, rows, schema.SALDOS)
