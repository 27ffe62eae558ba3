"""Natural language to SQL: generate, guard, validate by analysis, retry, execute."""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..schema import QueryGenerationError, TextQueryTimeout, UnsafeQuery

RETRIES, ROW_LIMIT = 2, 100
#: Nodes of parsed statements that do anything but read.
_WRITES = re.compile(r"Command$|Statement$|^(Insert|Create|Replace|Drop|Delete|Update|Merge|Alter|Add|Rename|Set|Truncate|Load|Cache|Uncache|Refresh|Call|Analyze|Repair|Recover|Append|Overwrite)")
_READS = re.compile(r"^\s*(?:--[^\n]*\n\s*)*(select|with|values|from)\b", re.I)


def check_read_only(spark: SparkSession, text: str) -> None:
    """Only one statement that reads. Decided on the parsed plan, so words inside literals do no harm."""
    if not _READS.match(text):
        raise UnsafeQuery("only queries that read are run")
    todo = [spark._jsparkSession.sessionState().sqlParser().parsePlan(text)]  # noqa: SLF001
    while todo:
        node = todo.pop()
        if _WRITES.search(node.getClass().getSimpleName()):
            raise UnsafeQuery("only queries that read are run")
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]


def explain(spark: SparkSession, text: str) -> str:
    """The formatted plan; raises if the text does not analyse."""
    df = spark.sql(text)
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))  # noqa: SLF001


def describe(spark: SparkSession, tables: list[str]) -> str:
    """Columns of the views that a generator may use."""
    return "\n".join(f"{t}({', '.join(f'{n} {k}' for n, k in spark.table(t).dtypes)})" for t in tables)


def ask(spark: SparkSession, question: str, tables: list[str], generate: Callable[[str, str, str | None], str], timeout: float = 10.0) -> DataFrame:
    """At most ROW_LIMIT rows of the query that ``generate(question, schema, failure)`` writes.

    A text that does not analyse is given back with the error, RETRIES times;
    one that writes is refused at once.  The whole takes ``timeout`` seconds at
    most; a running job is cancelled by its tag.
    """
    began, failure, schema = time.monotonic(), None, describe(spark, tables)
    for _ in range(RETRIES + 1):
        text = generate(question, schema, failure)
        if time.monotonic() - began > timeout:
            raise TextQueryTimeout(question)
        try:
            check_read_only(spark, text)
            found = spark.sql(text).limit(ROW_LIMIT)
        except PySparkException as e:
            failure = str(e)
            continue
        except UnsafeQuery:
            raise
        except Exception as e:  # noqa: BLE001  the parser's own errors come from the JVM
            failure = str(e)
            continue
        tag = f"textquery-{uuid.uuid4().hex}"
        timer = threading.Timer(max(0.01, timeout - (time.monotonic() - began)), lambda t=tag: spark.interruptTag(t))
        spark.addTag(tag)
        timer.start()
        try:
            rows = found.collect()
        except Exception as e:
            raise (TextQueryTimeout(question) if time.monotonic() - began >= timeout else e) from e
        finally:
            timer.cancel()
            spark.removeTag(tag)
        return spark.createDataFrame(rows, found.schema)
    raise QueryGenerationError(failure or question)
