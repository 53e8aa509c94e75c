"""Normal forms of ids, event types, node types and sources, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters cut off at both ends: ASCII blanks and control blanks, NBSP, ideographic space.
BLANKS = " \t\n\r\f\v\u00a0\u3000"

#: Names of the audit format and their canonical type.
TYPE_NAMES = {
    "file_object_file": "file",
    "file_object_directory": "dir",
    "file_object_socket": "socket",
    "file_object_fifo": "fifo",
    "file_object_char": "chardev",
    "net_flow_object": "netflow",
    "subject_process": "process",
    "ipc_object": "ipc",
    "unprincipled": "object",
}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare(c) -> Column:
    """The string without outer blanks, in lower case; null stays null."""
    return F.lower(F.btrim(_col(c), F.lit(BLANKS)))


def node_key(c) -> Column:
    return bare(c)


def source_form(c) -> Column:
    return bare(c)


def etype_form(c) -> Column:
    """Event type without outer blanks, lower case, without a leading ``event_``; null, blank or nothing left gives ``event``."""
    cut = F.regexp_replace(bare(c), "^event_", "")
    return F.when(cut.isNull() | (cut == ""), F.lit("event")).otherwise(cut)


def type_form(c) -> Column:
    """Node type in its canonical name; null stays null, blank stays ''."""
    b = bare(c)
    names = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, b), b)
