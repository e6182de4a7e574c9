"""Manifests: a JSON file per version that lists its segments, written after them and never changed but for statistics."""

from __future__ import annotations

import base64
import json
import pickle
import re
import time
from dataclasses import asdict, dataclass, field
from typing import Any
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import types as T

from tidemark.errors import NoSuchVersionError, UserInputError
from tidemark.sources.files import Folder
from tidemark.sources.segments import Segment


_PICKLED = "__pickled__"


@dataclass
class Manifest:
    version: int
    created: int
    index: str | None
    forms: list[dict]
    schema: dict
    segments: list[Segment]
    metadata: Any = None
    pickled: bool = False
    sorted: bool = True
    #: Tokens of staged rows that are in this version or were in one before it, the latest ones.
    adopted: list[str] = field(default_factory=list)

    @property
    def rows(self) -> int:
        return sum(s.rows for s in self.segments)

    def struct(self) -> T.StructType:
        return T.StructType.fromJson(self.schema)

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"metadata": packed(self.metadata)})

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        raw["metadata"] = unpacked(raw["metadata"])
        raw["segments"] = [Segment(**s) for s in raw["segments"]]
        return cls(**raw)


def packed(value: Any) -> Any:
    """Metadata as JSON has it: as it is, if that gives it back, or else pickled."""
    try:
        if json.loads(json.dumps(value)) == value and not (isinstance(value, dict) and set(value) == {_PICKLED}):
            return value
    except (TypeError, ValueError):
        pass
    return {_PICKLED: base64.b64encode(pickle.dumps(value)).decode()}


def unpacked(value: Any) -> Any:
    return pickle.loads(base64.b64decode(value[_PICKLED])) if isinstance(value, dict) and set(value) == {_PICKLED} else value


@dataclass(frozen=True)
class VersionInfo:
    version: int
    date: pd.Timestamp
    deleted: bool
    snapshots: list[str] = field(default_factory=list)


def safe(name: str) -> str:
    """A symbol's name as a file name."""
    if not name:
        raise UserInputError("a name must not be empty")
    return quote(name, safe="")


class Catalog:
    """Versions and snapshots of a library, as files."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def symbol(self, name: str) -> str:
        return f"symbols/{safe(name)}"

    def symbols(self) -> list[str]:
        return [s for s in map(unquote, self.folder.names("symbols")) if self.latest(s) is not None]

    def numbers(self, symbol: str, deleted: bool = False) -> list[int]:
        """Version numbers, ascending; deleted: those that were deleted too."""
        found = self.folder.names(f"{self.symbol(symbol)}/versions")
        gone = {int(n[1:9]) for n in found if n.endswith(".deleted")}
        return [v for v in sorted(int(n[1:9]) for n in found if re.fullmatch(r"v\d{8}\.json", n)) if deleted or v not in gone]

    def latest(self, symbol: str) -> int | None:
        return max(self.numbers(symbol), default=None)

    def _file(self, symbol: str, version: int) -> str:
        return f"{self.symbol(symbol)}/versions/v{version:08d}.json"

    def load(self, symbol: str, version: int) -> Manifest:
        return Manifest.from_json(self.folder.read(self._file(symbol, version)))

    def commit(self, symbol: str, manifest: Manifest) -> Manifest:
        """Writes a new version under the next free number: of two writers, the later one's is the newer version."""
        taken = self.numbers(symbol, deleted=True)
        manifest.version = max(taken, default=-1) + 1
        manifest.created = time.time_ns()
        while not self.folder.create(self._file(symbol, manifest.version), manifest.to_json()):
            manifest.version += 1
        return manifest

    def replace(self, symbol: str, manifest: Manifest) -> None:
        self.folder.put(self._file(symbol, manifest.version), manifest.to_json())

    def mark_deleted(self, symbol: str, version: int) -> None:
        self.folder.put(self._file(symbol, version) + ".deleted", "{}")

    # snapshots

    def snapshots(self) -> dict[str, dict]:
        return {unquote(n.removesuffix(".json")): self._snapshot(n) for n in self.folder.names("snapshots")}

    def _snapshot(self, file: str) -> dict:
        content = json.loads(self.folder.read(f"snapshots/{file}"))
        return content | {"metadata": unpacked(content["metadata"])}

    def snapshot(self, name: str) -> dict:
        if not self.folder.exists(f"snapshots/{safe(name)}.json"):
            raise NoSuchVersionError(f"there is no snapshot {name}")
        return self._snapshot(f"{safe(name)}.json")

    def put_snapshot(self, name: str, content: dict) -> None:
        self.folder.put(f"snapshots/{safe(name)}.json", json.dumps(content | {"metadata": packed(content["metadata"])}))

    def drop_snapshot(self, name: str) -> None:
        self.snapshot(name)
        self.folder.delete(f"snapshots/{safe(name)}.json")

    def resolve(self, symbol: str, as_of: Any = None) -> Manifest:
        """A version by number (negative: from the latest back), snapshot or time; the latest, if None."""
        alive = self.numbers(symbol)
        if isinstance(as_of, str):
            pinned = self.snapshot(as_of)["versions"]
            if symbol not in pinned:
                raise NoSuchVersionError(f"{symbol} is not in snapshot {as_of}")
            return self.load(symbol, pinned[symbol])
        if as_of is None:
            if not alive:
                raise NoSuchVersionError(f"there is no symbol {symbol}")
            return self.load(symbol, alive[-1])
        if isinstance(as_of, int):
            wanted = as_of if as_of >= 0 else (alive[as_of] if -as_of <= len(alive) else None)
            pinned = {s["versions"].get(symbol) for s in self.snapshots().values()}
            if wanted is None or wanted not in alive and wanted not in pinned:
                raise NoSuchVersionError(f"{symbol} has no version {as_of}")
            return self.load(symbol, wanted)
        t = pd.Timestamp(as_of)
        limit = (t.tz_localize("UTC") if t.tzinfo is None else t).value
        for v in reversed(alive):
            found = self.load(symbol, v)
            if found.created <= limit:
                return found
        raise NoSuchVersionError(f"{symbol} had no version at {as_of}")

    def pinned(self, symbol: str) -> set[int]:
        """Versions that snapshots hold."""
        return {s["versions"][symbol] for s in self.snapshots().values() if symbol in s["versions"]}
