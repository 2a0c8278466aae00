"""Raw probe and capture texts to typed values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ladders as L

# The text a source writes in place of a hidden network name.
REDACTED = "<redacted>"
_NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _int(text: Column) -> Column:
    return F.when(text.rlike("^-?[0-9]{1,9}$"), text.cast("int"))


def ssid(raw: Column) -> Column:
    """The network name; null where hidden, empty or missing."""
    return F.when(~F.lower(raw).isin(REDACTED, ""), raw)


def _dbm(raw: Column, part: int) -> Column:
    piece = F.get(F.split(raw, "/"), F.lit(part))
    return _int(F.trim(F.regexp_extract(piece, r"^([0-9\-\s]*)", 1)))


def signal_dbm(raw: Column) -> Column:
    """First value of ``-42 dBm / -97 dBm``."""
    return _dbm(raw, 0)


def noise_dbm(raw: Column) -> Column:
    return _dbm(raw, 1)


def channel(raw: Column) -> Column:
    """``149 (5GHz, 80MHz)`` or ``149,80`` as struct(number, band, width);
    null without a leading number."""
    text = F.trim(raw)
    number = _int(F.regexp_extract(text, "^([0-9]+)", 1))
    rest = F.lower(F.regexp_extract(text, r"^[0-9]+([\s\S]*)$", 1))
    band = (
        F.when(rest.rlike("6 ?ghz"), "SixGhz")
        .when(rest.rlike("5 ?ghz"), "FiveGhz")
        .when(rest.rlike(r"2 ?ghz|2\.4"), "TwoPointFourGhz")
        .otherwise(L.band_from_channel(number))
    )
    # Digits right before the first "mhz", else the first digits that follow.
    named = _int(F.regexp_extract(rest, r"^(?:(?!mhz)[\s\S])*?(?<![0-9])([0-9]+)mhz", 1))
    width = F.coalesce(named, _int(F.regexp_extract(rest, "([0-9]+)", 1)))
    width = F.when(width.isin(20, 40, 80, 160), F.concat(F.lit("Mhz"), width.cast("string")))
    return F.when(
        number <= 65535,
        F.struct(number.alias("number"), band.alias("band"), width.alias("width")),
    )


def security(raw: Column) -> Column:
    """Security mode; null stays null."""
    s = F.lower(raw)
    return (
        F.when(s.isNull(), None)
        .when(s.contains("wpa3_transition"), "Wpa3Transition")
        .when(s.contains("wpa3"), "Wpa3")
        .when(s.contains("wpa2"), "Wpa2")
        .when(s.contains("wpa"), "Wpa")
        .when(s.contains("wep"), "Wep")
        .when(s.contains("_none") | s.isin("none", ""), "Open")
        .otherwise("Unknown")
    )


def observation_confidence(*needed: Column) -> Column:
    """Direct when everything identifying was readable, else Inferred."""
    missing = F.lit(False)
    for value in needed:
        missing = missing | value.isNull()
    return F.when(missing, "Inferred").otherwise("Direct")


def ping_ms(text: Column) -> Column:
    """Value of the first readable ``time=`` token; null without a reply."""
    found = F.regexp_extract_all(text, F.lit(rf"(?<!\S)time=({_NUMBER})(?!\S)"), F.lit(1))
    return F.get(found, F.lit(0)).cast("double")
