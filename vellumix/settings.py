"""Settings from an environment file and the process environment, which wins."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumix.errors import ConfigError
from vellumix.functions.text import MODES

PREFIX = "VELLUMIX_"
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


@dataclass(frozen=True)
class Settings:
    ocr_text_threshold: int = 50
    ocr_language: str = "eng"
    max_concurrency: int = 2
    retry_attempts: int = 3
    cache_dir: str = ".cache/vellumix"
    jobs_dir: str = ".jobs/vellumix"
    symbol_fix_mode: str = "conservative"
    converter_command: str = "marker_single"
    converter_format: str = "markdown"
    force_ocr: bool = False
    web_host: str = "127.0.0.1"
    web_port: int = 10001
    max_upload_mb: int = 30
    chunk_chars: int = 4000
    llm_api_key: str = ""
    llm_base_url: str = ""
    llm_model: str = ""


LEAST = {"ocr_text_threshold": 0, "max_concurrency": 1, "retry_attempts": 1, "web_port": 1, "max_upload_mb": 1, "chunk_chars": 200}
ONLINE = ("llm_api_key", "llm_base_url", "llm_model")


def env_entry(line: str) -> tuple[str, str] | None:
    """Key and value of an environment file's line, or None for a comment or other text."""
    line = line.strip()
    if line.startswith("export "):
        line = line[7:].lstrip()
    if not line or line.startswith("#") or "=" not in line:
        return None
    key, _, value = line.partition("=")
    return key.strip(), value.strip().strip("\"'")


def duplicates(lines: Iterable[str], keys: Iterable[str]) -> dict[str, list[int]]:
    """Line numbers (from 1) of keys that are set more than once."""
    wanted, seen = set(keys), {}
    for n, line in enumerate(lines, 1):
        entry = env_entry(line)
        if entry and entry[0] in wanted:
            seen.setdefault(entry[0], []).append(n)
    return {k: v for k, v in sorted(seen.items()) if len(v) > 1}


def duplicate_keys(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(key, line_nos) of keys set more than once in (file, line_no, line), for many files at once."""
    entry = F.regexp_replace(F.trim(F.col("line")), r"^export ", "")
    own = lines.where(~F.trim(entry).startswith("#") & F.contains(entry, F.lit("="))).withColumn("key", F.trim(F.substring_index(entry, "=", 1)))
    return own.where(F.col("key").isin(keys)).groupBy("file", "key").agg(F.sort_array(F.collect_list("line_no")).alias("line_nos")).where(F.size("line_nos") > 1)


def load(lines: Iterable[str] = (), environment: Mapping[str, str] | None = None, online: bool = False) -> Settings:
    """Settings from a file's lines and the environment; raises ConfigError for what isn't right."""
    lines = list(lines)
    names = {PREFIX + f.name.upper(): f for f in fields(Settings)}
    if twice := duplicates(lines, names):
        raise ConfigError("keys set more than once: " + "; ".join(f"{k} (lines {','.join(map(str, v))})" for k, v in twice.items()))
    found = dict(e for line in lines if (e := env_entry(line)))
    found |= {k: v for k, v in (os.environ if environment is None else environment).items() if k in names}
    values = {}
    for key, field in names.items():
        raw = found.get(key, "").strip()
        if not raw:
            continue
        kind = type(field.default)
        if kind is bool:
            if raw.lower() not in TRUE + FALSE:
                raise ConfigError(f"{key} is neither true nor false: {raw}")
            values[field.name] = raw.lower() in TRUE
        elif kind is int:
            try:
                values[field.name] = int(raw)
            except ValueError:
                raise ConfigError(f"{key} is not a whole number: {raw}") from None
        else:
            values[field.name] = raw
    out = Settings(**values)
    for name, least in LEAST.items():
        if getattr(out, name) < least:
            raise ConfigError(f"{PREFIX}{name.upper()} must be at least {least}")
    if out.symbol_fix_mode not in MODES:
        raise ConfigError(f"{PREFIX}SYMBOL_FIX_MODE must be one of {', '.join(MODES)}")
    if out.converter_format != "markdown":
        raise ConfigError(f"{PREFIX}CONVERTER_FORMAT can only be markdown")
    if online and (missing := [n for n in ONLINE if not getattr(out, n)]):
        raise ConfigError("missing: " + ", ".join(PREFIX + n.upper() for n in missing))
    return out
