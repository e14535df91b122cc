"""Run configurations on the driver: YAML with overrides, typed sections, canonical hash, flat columns, snapshot."""

from __future__ import annotations

import copy
import datetime as dt
import hashlib
import json
import os
import re
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..errors import ConfigError

#: Fixed names: what doesn't count for a run's identity.
UNHASHED = ("run_id", "output_root", "overwrite", "resume", "workers")
#: What the encoder knows.
PRESETS = ("ultrafast", "superfast", "veryfast", "faster", "fast", "medium", "slow", "slower", "veryslow")
TUNES = ("film", "animation", "grain", "stillimage", "fastdecode", "zerolatency")
_SEGMENT = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def merged(base: Mapping, over: Mapping) -> dict:
    """Mappings merge, everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def _yaml(text: str, where: str):
    import yaml

    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"{where}: not YAML: {e}") from e


def override(text: str) -> dict:
    """a.b=value as a nested mapping; the value is YAML."""
    path, eq, value = text.partition("=")
    parts = path.strip().split(".")
    if not eq or not all(parts):
        raise ConfigError(f"not key=value: {text!r}")
    out = _yaml(value, text) if value.strip() else None
    for p in reversed(parts):
        out = {p: out}
    return out


def load(path: str, overrides: list[str] | None = None) -> dict:
    """A file's mapping with the overrides, a later one over an earlier one."""
    try:
        text = Path(path).read_text(encoding="utf-8")
    except FileNotFoundError:
        raise ConfigError(f"no config file {path}") from None
    out = _yaml(text, str(path))
    if not isinstance(out, Mapping) or not out:
        raise ConfigError(f"{path}: not a mapping, or empty")
    for o in overrides or []:
        out = merged(out, override(o))
    return dict(out)


def canonical(config: Mapping) -> str:
    kept = {k: v for k, v in config.items() if k != "run"}
    if "run" in config:
        kept["run"] = {k: v for k, v in config["run"].items() if k not in UNHASHED}
    return json.dumps(kept, sort_keys=True, separators=(",", ":"), default=str)


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(canonical(config).encode()).hexdigest()[:12]


@F.arrow_udf(StringType())
def _hashed(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else config_hash(json.loads(t)) for t in text.to_pylist()], pa.string())


def config_hashes(config: Column, kind: str = "string") -> Column:
    """config_hash() of a column that holds configurations: JSON text or, by kind, structs, maps or variants; null stays null.

    Their form is the one that the digest of a file's configuration is taken of: keys sorted at every level, numbers and
    escapes as Python's json writes them, run's settings that don't touch the results left out. Fields that are null are kept.
    """
    return _hashed(config if kind == "string" else F.to_json(config, {"ignoreNullFields": "false"}))


def flat(config: Mapping, prefix: str = "") -> dict[str, object]:
    """Dotted names; lists as JSON text."""
    out: dict[str, object] = {}
    for k, v in config.items():
        if isinstance(v, Mapping):
            out |= flat(v, f"{prefix}{k}.")
        else:
            out[prefix + str(k)] = json.dumps(list(v), default=str) if isinstance(v, list | tuple) else v
    return out


def run_id(config: Mapping, now: dt.datetime | None = None) -> str:
    """The id that the run section gives, or one of the time and the configuration's hash."""
    given = (config.get("run") or {}).get("run_id")
    if given is not None and not _SEGMENT.fullmatch(str(given)):
        raise ConfigError(f"run.run_id: {given!r} is no name for a folder")
    return given or f"{now or dt.datetime.now():%Y%m%d-%H%M%S}-{config_hash(config)}"


class Reader:
    """Typed access to a section; done() rejects keys that nobody asked for.

    A null counts as missing where there is a default. A truth value is no number.
    """

    def __init__(self, data: object, where: str = ""):
        if data is not None and not isinstance(data, Mapping):
            raise ConfigError(f"{where or 'config'} must be a mapping, is {type(data).__name__}")
        self.data, self.where, self.asked = dict(data or {}), where, set()

    def _at(self, key: str) -> str:
        return f"{self.where}.{key}".strip(".")

    def get(self, key: str, kind: type | tuple[type, ...], default: object = ..., *, least: float | None = None, most: float | None = None, among: tuple | None = None):
        self.asked.add(key)
        v = self.data.get(key)
        if v is None:
            if default is ...:
                raise ConfigError(f"{self._at(key)} is missing")
            return default
        kinds = kind if isinstance(kind, tuple) else (kind,)
        if float in kinds and int not in kinds and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if not isinstance(v, kinds) or (isinstance(v, bool) and bool not in kinds):
            raise ConfigError(f"{self._at(key)} must be {' or '.join(k.__name__ for k in kinds)}, is {v!r}")
        if (least is not None and v < least) or (most is not None and v > most) or (among is not None and v not in among):
            raise ConfigError(f"{self._at(key)} is out of range: {v!r}")
        return v

    def path(self, key: str, default: object = ...) -> Path | None:
        v = self.get(key, (str, Path), default)
        if v == "":
            raise ConfigError(f"{self._at(key)} is empty")
        return Path(os.path.expanduser(v)) if v is not None else None

    def items(self, key: str, kind: type | tuple[type, ...], default: object = ..., *, least: int = 0) -> list:
        v = self.get(key, (list, tuple), default)
        if v is None:
            return v
        kinds = kind if isinstance(kind, tuple) else (kind,)
        for i, x in enumerate(v):
            if not isinstance(x, kinds) or (isinstance(x, bool) and bool not in kinds):
                raise ConfigError(f"{self._at(key)}[{i}] must be {' or '.join(k.__name__ for k in kinds)}, is {x!r}")
        if len(v) < least:
            raise ConfigError(f"{self._at(key)} needs {least} or more, has {len(v)}")
        return list(v)

    def section(self, key: str) -> Reader:
        return Reader(self.get(key, dict, {}), self._at(key))

    def done(self) -> None:
        if unknown := sorted(set(map(str, self.data)) - self.asked):
            raise ConfigError(f"{self.where or 'config'}: unknown {unknown}, known are {sorted(self.asked)}")


@dataclass(frozen=True)
class Video:
    """How an encoder is to write."""

    fps: int = 30
    crf: int = 18
    preset: str = "veryfast"
    tune: str | None = "stillimage"
    pix_fmt: str = "yuv420p"
    codec: str = "libx264"
    threads: int = 0

    @classmethod
    def read(cls, r: Reader) -> Video:
        tune = None if r.data.get("tune", "") is None else r.get("tune", str, cls.tune, among=TUNES)
        r.asked.add("tune")
        out = cls(
            r.get("fps", int, cls.fps, least=1, most=240), r.get("crf", int, cls.crf, least=0, most=51), r.get("preset", str, cls.preset, among=PRESETS),
            tune, r.get("pix_fmt", str, cls.pix_fmt), r.get("codec", str, cls.codec), r.get("threads", int, cls.threads, least=0, most=64),
        )
        r.done()
        return out


@dataclass(frozen=True)
class Run:
    """Where a run writes and how it is done."""

    output_root: Path = Path("data")
    run_id: str | None = None
    seed: int = 1234
    workers: int = 8
    overwrite: bool = False
    resume: bool = True

    @classmethod
    def read(cls, r: Reader) -> Run:
        out = cls(
            r.path("output_root", cls.output_root), r.get("run_id", str, None), r.get("seed", int, cls.seed, least=0), r.get("workers", int, cls.workers, least=1, most=256),
            r.get("overwrite", bool, cls.overwrite), r.get("resume", bool, cls.resume),
        )
        r.done()
        if out.overwrite and out.resume:
            raise ConfigError("run: overwrite and resume can't both be true")
        run_id({"run": {"run_id": out.run_id}}, dt.datetime.min)
        return out


@dataclass(frozen=True)
class Settings:
    """A whole configuration: what every experiment has, and the experiment's own params as they are."""

    experiment: str
    run: Run = field(default_factory=Run)
    video: Video = field(default_factory=Video)
    params: dict = field(default_factory=dict)
    path: str | None = None

    @classmethod
    def of(cls, data: Mapping, path: str | None = None) -> Settings:
        r = Reader(data)
        out = cls(r.get("experiment", str), Run.read(r.section("run")), Video.read(r.section("video")), dict(r.get("params", dict, {})), path)
        r.done()
        return out

    @classmethod
    def load(cls, path: str, overrides: list[str] | None = None) -> Settings:
        return cls.of(load(path, overrides), str(path))

    def as_dict(self) -> dict:
        run = asdict(self.run) | {"output_root": str(self.run.output_root)}
        return {"experiment": self.experiment, "run": run, "video": asdict(self.video), "params": copy.deepcopy(self.params)}

    def hash(self) -> str:
        return config_hash(self.as_dict())

    def columns(self) -> dict[str, object]:
        """The configuration as cfg_ columns of a manifest."""
        return {f"cfg_{k}": v for k, v in flat(self.as_dict()).items()}

    def snapshot(self, path: str | Path, now: dt.datetime | None = None) -> None:
        """Write what the run was made from, with its hash, file and time under _meta."""
        import yaml

        meta = {"config_hash": self.hash(), "source_path": self.path, "written_at": (now or dt.datetime.now()).isoformat(timespec="seconds")}
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(yaml.safe_dump(self.as_dict() | {"_meta": meta}, sort_keys=False, allow_unicode=True), encoding="utf-8")
