"""Java functions for SQL: a small class, compiled by the compiler that Spark's own code generation uses, shipped as a jar.

Some loops can't be expressed by built-in functions and are far too slow in Python, such as an adaptive bit coder. Such a loop is one
Java class here. It is compiled once per application and added to it as a jar, so every executor, also one that starts later, fetches
it from the driver.
"""

from __future__ import annotations

import json
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession
from pyspark.sql.types import _parse_datatype_string

_LOADED: dict[tuple, object] = {}


def register(spark: SparkSession, name: str, class_name: str, source: str, returns: str) -> None:
    """Makes ``class_name`` of ``source``, one of UDF1 to UDF22 of org.apache.spark.sql.api.java, callable as SQL function ``name``."""
    sc, jvm = spark.sparkContext, spark.sparkContext._jvm
    key = (sc.applicationId, source)
    if key not in _LOADED:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.Thread.currentThread().getContextClassLoader())
        compiler.cook(source)
        codes = compiler.getBytecodes()
        # the driver itself serves this file to the executors, so its own disk will do
        path = os.path.join(tempfile.mkdtemp(prefix="quillspark-jar-"), f"{class_name.lower()}.jar")
        with zipfile.ZipFile(path, "w") as z:
            for entry in codes.keySet().toArray():
                z.writestr(f"{entry.replace('.', '/')}.class", bytes(codes.get(entry)))
        sc._jsc.sc().addJar(path)
        _LOADED[key] = compiler.getClassLoader()
    schema = jvm.org.apache.spark.sql.types.DataType.fromJson(json.dumps(_parse_datatype_string(returns).jsonValue()))
    spark._jsparkSession.udf().register(name, _LOADED[key].loadClass(class_name).newInstance(), schema)
