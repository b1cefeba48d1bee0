"""Versioned zone transition tables.

A table holds, for one IANA zone, the UTC second of every change of offset between
1970 and 2100 with the offset and abbreviation that hold from then on. Changes that the zone's file lists are
taken from there, those that its closing rule makes are found by probing behind them. ``tz_version`` names the release of
the machine's time-zone database so that a job can insist that every executor uses the release of the driver.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zoneinfo
from datetime import datetime, timezone
from functools import lru_cache
from typing import NamedTuple

import numpy as np

FIRST, LAST, STEP = 0, 4102444800, 3 * 86400  # 1970-01-01, 2100-01-01, probe distance in seconds


class ZoneTable(NamedTuple):
    """starts[i] is the first UTC second at which offsets[i] and names[i] hold."""

    starts: np.ndarray
    offsets: np.ndarray
    names: np.ndarray


def _zone_file(name: str) -> bytes | None:
    """Contents of a zone's file, of the system's database or else the packaged one."""
    for folder in zoneinfo.TZPATH:
        path = os.path.join(folder, *name.split("/"))
        if os.path.isfile(path):
            with open(path, "rb") as f:
                return f.read()
    try:
        from importlib.resources import files

        return files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
    except (ImportError, OSError):
        return None


@lru_cache(maxsize=1)
def tz_version() -> str:
    """Release of the zone database; where the machine does not name it, a digest of its zones."""
    for folder in zoneinfo.TZPATH:
        for name in ("tzdata.zi", "+VERSION"):
            path = os.path.join(folder, name)
            if os.path.exists(path):
                with open(path, encoding="ascii", errors="replace") as f:
                    return f.readline().replace("# version", "").strip()
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        digest = hashlib.sha256()
        for name in sorted(zoneinfo.available_timezones()):
            digest.update(name.encode() + (_zone_file(name) or b""))
        return f"digest {digest.hexdigest()}"


def listed_changes(name: str) -> list[int]:
    """UTC seconds of the changes that a zone's file lists (TZif, its 64-bit part)."""
    data = _zone_file(name) or b""
    if data[:4] != b"TZif" or data[4:5] < b"2":
        return []
    utc, std, leap, times, types, chars = struct.unpack(">6l", data[20:44])
    at = 44 + times * 5 + types * 6 + chars + leap * 8 + std + utc  # behind the 32-bit part
    times = struct.unpack(">6l", data[at + 20 : at + 44])[3]
    return list(struct.unpack(f">{times}q", data[at + 44 : at + 44 + 8 * times]))


@lru_cache(maxsize=1024)
def zone_table(name: str | None) -> ZoneTable | None:
    """Transition table of a zone, or None for a name that the database lacks."""
    try:
        zone = zoneinfo.ZoneInfo(name) if name else None
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        zone = None
    if zone is None:
        return None

    def state(second: int) -> tuple[int, str]:
        at = datetime.fromtimestamp(second, timezone.utc).astimezone(zone)
        return int(at.utcoffset().total_seconds()), at.tzname()

    rows = [(FIRST - 86400 * 366, *state(FIRST))]
    before, at = state(FIRST), FIRST
    for second in [s for s in listed_changes(name) if FIRST < s < LAST]:
        if (now := state(second)) != before:
            rows.append((second, *now))
            before = now
        at = second
    for second in range(at + STEP, LAST, STEP):
        now = state(second)
        if now != before:
            low, high = second - STEP, second
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if state(mid) == before else (low, mid)
            rows.append((high, *state(high)))
            before = now
    starts, offsets, names = zip(*rows)
    return ZoneTable(np.array(starts, "int64"), np.array(offsets, "int64"), np.array(names, dtype=object))


def offset_at(table: ZoneTable, seconds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offset that holds at each UTC second, and its row in the table."""
    row = np.clip(np.searchsorted(table.starts, seconds, side="right") - 1, 0, None)
    return table.offsets[row], row


def wall_to_utc(table: ZoneTable, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTC second of each wall-clock second and whether the zone had it exactly once."""
    early, _ = offset_at(table, wall - 86400)
    late, _ = offset_at(table, wall + 86400)
    first, second = wall - early, wall - late
    first_ok = offset_at(table, first)[0] == early
    second_ok = offset_at(table, second)[0] == late
    once = (first_ok ^ second_ok) | (first_ok & second_ok & (first == second))
    return np.where(first_ok, first, second), once
