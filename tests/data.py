"""Small hand-made tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema

from tillwise.schemas import CANONICAL

DAY = dt.date(2024, 3, 1)


def frame(spark, rows, schema):
    """A local table whose size Spark knows; rows are tuples or dicts, numbers become decimals where the schema says so."""

    def cell(value, field):
        if value is not None and field.dataType.typeName() == "decimal":
            return Decimal(str(value))
        return value

    named = [r if isinstance(r, dict) else dict(zip(schema.names, r, strict=True)) for r in rows]
    cells = [{f.name: cell(r.get(f.name), f) for f in schema.fields} for r in named]
    return spark.createDataFrame(pa.Table.from_pylist(cells, to_arrow_schema(schema)), schema)


def table(spark, name, rows):
    """A canonical table; columns left out are NULL."""
    return frame(spark, rows, CANONICAL[name])


def sale(product="A", qty=1, price=10, discount=0, net=None, day=DAY, **more):
    qty, price = Decimal(str(qty)), Decimal(str(price))
    net = qty * price - discount if net is None else net
    return {
        "transaction_id": "t1", "sale_day": day, "product_id": product,
        "product_name": None if product is None else f"name {product}", "quantity": qty, "unit_price": price,
        "gross_sales": qty * price, "discount": discount, "net_sales": net, "tax": 0, "line_total": net,
        "payment_type": "CARD", "tip_amount": 0, **more,
    }


def product(product="A", cogs=4, **more):
    return {"product_id": product, "product_name": f"name {product}", "cogs": cogs, **more}


def dicts(df):
    return [r.asDict() for r in df.collect()]
