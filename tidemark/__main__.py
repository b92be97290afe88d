"""python -m tidemark fs list --data FOLDER"""

import sys

from pyspark.sql import SparkSession

from tidemark import commands

if __name__ == "__main__":
    for line in commands.run(SparkSession.builder.getOrCreate(), sys.argv[1:]):
        print(line)
