"""``python -m tarnfold``: indexes the directories of TARNFOLD_PATHS."""

from pyspark.sql import SparkSession

from tarnfold.config import from_env
from tarnfold.service import index_all

if __name__ == "__main__":
    session = SparkSession.builder.appName("tarnfold").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for line in index_all(session, from_env()):
        print(line)
