"""python -m lexigraph build FOLDER WAREHOUSE | run QUERY FOLDER OUT."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from lexigraph.session import scratch


def main(args: list[str]) -> None:
    if len(args) == 3 and args[0] == "build":
        from lexigraph.plans.build import build_index

        print(build_index(SparkSession.builder.getOrCreate(), args[1], args[2]))
    elif len(args) == 4 and args[0] == "run":
        from lexigraph.plans.queries import QUERIES

        spark = SparkSession.builder.getOrCreate()
        with scratch(spark):
            QUERIES[args[1]](spark, args[2]).write.parquet(args[3])
    else:
        sys.exit(__doc__)


if __name__ == "__main__":
    main(sys.argv[1:])
