"""python -m pagewarden FOLDER < settings.json: audits a folder, prints the report; exit code 0, 1 if it fails, 2 if it can't run."""

from __future__ import annotations

import json
import sys
from typing import TextIO

from pyspark.sql import SparkSession

from .plans import audit
from .plans.config import config


def main(arguments: list[str], given: TextIO, out: TextIO, problems: TextIO) -> int:
    try:
        if len(arguments) != 1:
            raise ValueError("one folder is asked for")
        text = given.read()
        settings = config(json.loads(text) if text.strip() else {})
        spark = SparkSession.builder.appName("pagewarden").getOrCreate()
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(arguments[0])
        store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not store.exists(where) or not store.getFileStatus(where).isDirectory():
            raise ValueError(f"there is no folder {arguments[0]}")
        done = audit(spark, arguments[0], settings)
        print(done.report(), file=out)
        code = done.run()
        done.close()
        return code
    except Exception as error:  # noqa: BLE001  whatever it is, the caller is told
        print(f"error: {error}", file=problems)
        return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:], sys.stdin, sys.stdout, sys.stderr))
