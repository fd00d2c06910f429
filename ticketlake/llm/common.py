"""Helpers shared by the operators: shared-folder tables, kernel shipping,
word splitting, and connected components over a table of links."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlake.operators.components import components as _components
from ticketlake.session import ensure_checkpoint_dir, write_and_read

#: A word: a run of characters other than space and U+0009..U+000D. It is the
#: rule of `bytes.split()`, which the Python kernels use on UTF-8 text.
WORD = r"[^\x20\x09-\x0D]+"


def by_value(module_name: str) -> None:
    """Ship a module's functions inside the task, so that executors need not
    have this package on their path."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


by_value(__name__)


def col(name: str) -> Column:
    """A column by its literal name (dots and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have, in any letter case."""
    have, name = {c.lower() for c in df.columns}, base
    while name.lower() in have:
        name += "_"
    return name


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage
    with files that outlive any executor. `session.scratch_tables` removes them."""
    return write_and_read(df, name)


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): connected components, a written table a round."""
    return _components(links, a, b, keep=lambda t: written(t, "links"))
