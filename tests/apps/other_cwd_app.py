"""Load the driver entry module by path from another working directory and
run queries whose Python UDFs must be imported by the workers."""

import importlib.util
import os
import sys

repo = sys.argv[1]
spec = importlib.util.spec_from_file_location("__spark_entry__", os.path.join(repo, "__spark_entry__.py"))
sys.path.insert(0, repo)
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)

from pyspark.sql import SparkSession  # noqa: E402

spark = SparkSession.builder.master("local[2]").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
n1 = len(entry.queries()["W1_byte_max"](spark, "/root/testdata/sf0.001").collect())
n3 = len(entry.queries()["W3_doc_pair_sign_sum"](spark, "/root/testdata/sf0.001").collect())
print(f"RESULT {n1} {n3}")
spark.stop()
