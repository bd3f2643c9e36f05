"""Corpus packages, registry headers, tag-sets and media folders.  Driver-side and small."""

from __future__ import annotations

import json
import os
import re
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import corpus_code


def flat_yaml(text: str) -> dict:
    """Mappings, lists and scalars by indentation: what headers and tag-sets use of YAML."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith(("#", "---"))]

    def scalar(x: str):
        x = x.strip()
        if x.startswith("{") and x.endswith("}"):
            return {k.strip(): scalar(v) for k, v in (p.split(":", 1) for p in _top_level(x[1:-1]))}
        if x.startswith("[") and x.endswith("]"):
            return [scalar(p) for p in _top_level(x[1:-1])]
        if len(x) > 1 and x[0] == x[-1] and x[0] in "\"'":
            return x[1:-1]
        return {"true": True, "false": False, "null": None, "~": None, "": None}.get(x, int(x) if re.fullmatch(r"-?\d+", x) else x)

    def block(at: int, indent: int) -> tuple[object, int]:
        out: object = None
        while at < len(lines) and lines[at][0] >= indent:
            depth, line = lines[at]
            if line.startswith("- "):
                out = [] if out is None else out
                inner = line[2:]
                if re.match(r"[\w.]+:(\s|$)", inner):
                    lines[at] = (depth + 2, inner)
                    item, at = block(at, depth + 2)
                else:
                    item, at = scalar(inner), at + 1
                out.append(item)
            else:
                out = {} if out is None else out
                key, _, rest = line.partition(":")
                if rest.strip():
                    out[scalar(key)], at = scalar(rest), at + 1
                elif at + 1 < len(lines) and (lines[at + 1][0] > depth or lines[at + 1][0] == depth and lines[at + 1][1].startswith("- ")):
                    out[scalar(key)], at = block(at + 1, lines[at + 1][0])
                else:
                    out[scalar(key)], at = None, at + 1
        return out, at

    return block(0, 0)[0] or {}


def _top_level(text: str) -> list[str]:
    """Parts between commas that are not inside brackets or quotes."""
    parts, depth, quote, start = [], 0, "", 0
    for k, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[start:k])
            start = k + 1
    return [p for p in [*parts, text[start:]] if p.strip()]


def registry_header(text: str) -> dict:
    """name, encoding, config, search_engine, cimdi of a registry file's first line."""
    first = re.sub(r"^#\s*", "", text.split("\n", 1)[0]).strip()
    body = first if first.startswith("{") else "\n".join(_top_level(first))
    found = flat_yaml(f"h: {first}")["h"] if first.startswith("{") else flat_yaml("\n".join(p.strip() for p in body.split("\n")))
    return {"encoding": "utf-8", "search_engine": "cwb"} | (found or {})


def unpack(package: str, target: str, known: set[str] = frozenset()) -> str:
    """Extracts a corpus zip's permitted entries; its code.  A known corpus is refused."""
    code = corpus_code(os.path.basename(package))
    if code in known:
        raise ValueError(f"corpus {code} exists")
    permitted = re.compile(rf"(cwb_dat/{code.upper()}/|cwb_reg/{code}$|media/{code}/|import/{code.upper()})")
    with zipfile.ZipFile(package) as z:
        for name in z.namelist():
            if permitted.match(name) and ".." not in Path(name).parts and not name.endswith("/"):
                z.extract(name, target)
    return code


def catalog(spark: SparkSession, headers: dict[str, dict]) -> DataFrame:
    """The corpora table: code and header fields, config as a map."""
    rows = [(c, h.get("name"), h.get("encoding"), h.get("search_engine"), {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in (h.get("config") or {}).items()}) for c, h in sorted(headers.items())]
    return spark.createDataFrame(rows, "code string, name string, encoding string, search_engine string, config map<string,string>")


def tag_sets(folder: str) -> dict[str, dict]:
    """Tag-sets by file stem; a YAML file replaces a JSON file of the same stem."""
    out = {p.stem: json.loads(p.read_text()) for p in sorted(Path(folder).glob("*.json"))}
    out |= {p.stem: flat_yaml(p.read_text()) for p in sorted([*Path(folder).glob("*.yml"), *Path(folder).glob("*.yaml")])}
    return out


def menu(spark: SparkSession, tag_set: dict) -> DataFrame:
    """(pos_attr, pos, feature_attr, value, label): a tag-set's tree, flattened."""
    tags = tag_set.get("tags", {})
    schema = "attr string, options array<struct<name:string,value:string,features:array<struct<attr:string,name:string,options:array<struct<name:string,value:string>>>>>>"
    row = spark.createDataFrame([(json.dumps({"attr": tags.get("attr", "pos"), "options": tags.get("options", [])}),)], "j string").select(F.from_json("j", schema).alias("t"))
    flat = row.select(F.col("t.attr").alias("pos_attr"), F.explode_outer("t.options").alias("o")).select("pos_attr", F.coalesce("o.value", "o.name").alias("pos"), F.explode_outer("o.features").alias("f"))
    return flat.select("pos_attr", "pos", F.col("f.attr").alias("feature_attr"), F.explode_outer("f.options").alias("v")).select("pos_attr", "pos", "feature_attr", "v.value", F.coalesce("v.name", "v.value").alias("label"))


def has_media(folder: str, code: str, kind: str) -> bool:
    """Whether a corpus has a file of ``kind`` (audio or video)."""
    top = Path(folder) / code / kind
    return top.is_dir() and any(p.is_file() for p in top.rglob("*"))


def languages_with_tags(languages: list[dict], tags: dict[str, dict]) -> list[dict]:
    """Language records with the tag-set that their ``tags`` names."""
    return [{**x, "tag_set": tags.get(x.get("tags"))} for x in languages]


def cimdi(header: dict, names: dict[str, str]) -> str:
    """A corpus's catalogue record as XML."""
    from xml.sax.saxutils import escape

    info = header.get("cimdi")
    if not info:
        raise ValueError("the corpus has no catalogue record")
    languages = info.get("languages") or []
    languages = languages if isinstance(languages, list) else [languages]
    value = lambda k: escape(str(info.get(k) or "No value given"))
    rows = "".join(f"<language><id>{escape(c)}</id><name>{escape(names.get(c, c))}</name></language>" for c in languages)
    kind = "multilingual" if len(languages) > 1 else "monolingual"
    return f"<resource><name>{escape(str(header.get('name') or 'No value given'))}</name><description>{value('description')}</description><licence>{value('licence')}</licence><lingualityType>{kind}</lingualityType>{rows}</resource>"
