"""``python -m tessera <prefix> [parts]``: fields of a stored raw graph and its triangle count.

``prefix`` names ``<prefix>.meta.txt``, ``.vertex.bin`` and ``.edge.bin``; ``parts`` sets the shuffle partitions.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from tessera.operators.graph import triangle_count
from tessera.sources.graph import read_csr, read_meta


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 1
    spark = SparkSession.builder.getOrCreate()
    if len(args) > 1:
        spark.conf.set("spark.sql.shuffle.partitions", int(args[1]))
    for name, value in read_meta(spark, args[0]).first().asDict().items():
        print(f"{name} {value}")
    print(f"total_num_triangles {triangle_count(read_csr(spark, args[0])).first()[0]}")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
