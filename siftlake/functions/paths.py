"""Path expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Working-copy roots, taken off once each in this order.
ROOTS = ("/work/", "./")


def normalized(path: Column, roots: Sequence[str] = ROOTS) -> Column:
    """Trimmed, with forward slashes, without scheme, working-copy roots and leading slashes."""
    out = F.regexp_replace(F.translate(F.btrim(path, F.lit(" \t\n\x0b\x0c\r")), "\\", "/"), "^file://", "")
    for root in roots:
        out = F.regexp_replace(out, "^" + re.escape(root), "")
    return F.regexp_replace(out, "^/+", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty without one."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)(\.[^.]*)$", 1))


def same_file(a: Column, b: Column) -> Column:
    """Equal, or one is the other's end at a slash; an empty `a` matches nothing."""
    return (a != "") & ((a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a)))


def resolved(path: Column) -> Column:
    """Dots taken out: "." goes, and ".." takes the segment before it with it; at the start ".." stays, and below a leading slash it goes."""
    rooted = path.startswith("/")
    empty = F.array().cast("array<string>")

    def step(done: Column, part: Column) -> Column:
        up = F.try_element_at(done, F.lit(-1))
        back = F.when(F.coalesce(up != "..", F.lit(False)), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.concat(done, F.array(part)))
        return F.when(part.isin("", "."), done).when(part == "..", back).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), empty, step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))
