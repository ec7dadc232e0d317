"""Regenerate ``oracle_doubles.py`` from the Spark schemas of the registered queries."""

from __future__ import annotations

import os
import pprint
import sys

from pyspark.sql.types import DoubleType


def double_columns(spark, sf_dir: str) -> dict[str, list[str]]:
    from latencylab.plans.catalog import queries

    out = {}
    for name, fn in sorted(queries().items()):
        schema = fn(spark, sf_dir).schema
        cols = [f.name for f in schema.fields if isinstance(f.dataType, DoubleType)]
        if cols:
            out[name] = cols
    return out


def main(sf_dir: str = "/root/testdata/sf0.001") -> None:
    from latencylab.session import local_session

    spark = local_session(4)
    cols = double_columns(spark, sf_dir)
    path = os.path.join(os.path.dirname(__file__), "oracle_doubles.py")
    header = open(path).read().split("DOUBLE_COLUMNS")[0]
    with open(path, "w") as f:
        f.write(header + "DOUBLE_COLUMNS: dict[str, list[str]] = " + pprint.pformat(cols, width=110) + "\n")


if __name__ == "__main__":
    main(*sys.argv[1:])
