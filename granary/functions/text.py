"""Paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that a file must not have, whatever follows their first dot.
RESERVED = r"(?i)^(con|prn|aux|nul|(com|lpt)[0-9])(\.|$)"


def last_part(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the last part of a path; empty if the dot begins it or there is none."""
    return F.regexp_extract(last_part(path), r"^.+\.([^.]*)$", 1)


def stem(path: Column) -> Column:
    """The path without that extension and its dot."""
    return F.when(last_part(path).rlike(r"^.+\.[^.]*$"), F.regexp_replace(path, r"\.[^.]*$", "")).otherwise(path)


def sanitize(name: Column) -> Column:
    """A file name: control and forbidden characters become _, white space at the ends and dots at the
    end go ("untitled" if nothing is left), device names get a _ in front, and it has at most 120 characters."""
    clean = F.regexp_replace(name, r'[\x00-\x1f\x7f-\x9f<>:"/\\|?*]', "_")
    clean = F.regexp_replace(F.regexp_replace(clean, r"^\p{Z}+|\p{Z}+$", ""), r"[. ]+$", "")
    clean = F.when(F.length(clean) > 0, clean).otherwise("untitled")
    clean = F.when(clean.rlike(RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)
    return F.when(name.isNotNull(), F.left(clean, F.lit(120)))


def printable(label: Column) -> Column:
    """A label without spaces (of any width) at its ends; null unless it has printable ASCII characters only, and one at least.

    ``\\z``, as ``$`` also matches before a last line break.
    """
    clean = F.regexp_replace(label, r"^\p{Zs}+|\p{Zs}+\z", "")
    return F.when(clean.rlike(r"^[\x20-\x7e]+\z"), clean)


def serial(text: Column) -> Column:
    """AAAA-ddddd of the first line BOOT or BOOT2 = DRIVE:\\AAAA_ddd.dd;1; null if it has none.

    What follows the last slash, backslash or colon counts, up to a semicolon: four letters, an
    underscore, and five digits among whatever else.
    """
    file = F.regexp_extract(text, r"(?im)^[ \t]*BOOT2?[ \t]*=[^\r\n]*?([^\\:/\r\n=]*)$", 1)
    file = F.trim(F.split(file, ";").getItem(0))
    digits = F.regexp_replace(F.substring(file, F.lit(6), F.length(file)), "[^0-9]", "")
    fine = file.rlike("^[A-Za-z]{4}_") & (F.length(digits) == 5)
    return F.when(fine, F.concat(F.upper(F.left(file, F.lit(4))), F.lit("-"), digits))


def titled(title: Column, serial: Column) -> Column:
    """The title with the serial in brackets, unless its letters and digits hold those of the serial."""
    plain = lambda c: F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    named = serial.isNotNull() & ~F.contains(plain(title), plain(serial))
    return F.when(named, F.concat(title, F.lit(" ("), serial, F.lit(")"))).otherwise(title)
