"""Java beside the Python code, compiled by the compiler that Spark has along and given to the executors as a jar."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_LOADERS: dict[tuple[str, str], object] = {}


def java_object(spark: SparkSession, name: str):
    """A new object of the class ``abundera.<name>`` from ``<name>.java`` beside this file; every executor knows the class."""
    key = spark.sparkContext.applicationId, name
    if key not in _LOADERS:
        compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(Path(__file__).with_name(f"{name}.java").read_text())
        jar = f"{tempfile.mkdtemp(prefix='abundera-')}/{name}.jar"
        with zipfile.ZipFile(jar, "w") as file:
            for k, code in dict(compiler.getBytecodes()).items():
                file.writestr(f"{k.replace('.', '/')}.class", bytes(code))
        spark.sparkContext._jsc.sc().addJar(jar)
        _LOADERS[key] = compiler.getClassLoader()
    made = _LOADERS[key].loadClass(f"abundera.{name}").getDeclaredConstructors()
    return made[0].newInstance(spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.Object, 0))


def map_partitions(df: DataFrame, function, schema: str) -> DataFrame:
    """``Dataset.mapPartitions`` with a Java function of rows."""
    spark = df.sparkSession
    kind = spark._jsparkSession.parseDataType(spark.createDataFrame([], schema).schema.json())
    return DataFrame(df._jdf.mapPartitions(function, spark.sparkContext._jvm.org.apache.spark.sql.Encoders.row(kind)), spark)
