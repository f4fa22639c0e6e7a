import sys
from pyspark.sql import SparkSession
from pyspark import StorageLevel
out = sys.argv[1]
spark = (SparkSession.builder.master("local[2]").appName("live-probe")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", out)
         .config("spark.eventLog.logBlockUpdates.enabled", "true")
         .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3")
         .getOrCreate())
df = spark.range(0, 1000, 1, 4).persist(StorageLevel.MEMORY_AND_DISK)
df.count()
g = df.groupBy((df.id % 5).alias("k")).count()
g.collect(); g.collect()   # second run: the map stage is skipped
df.unpersist()
spark.stop()
