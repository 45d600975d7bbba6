"""Dataset descriptions in XML, and catalogs of them."""

from __future__ import annotations

import logging
import os
import xml.etree.ElementTree as ET
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from funcframe import operators as ops
from funcframe.dataset import Dataset, granules
from funcframe.model import Function, Index, ModelError, Scalar, Tuple, Type
from funcframe.sources import files, text

log = logging.getLogger(__name__)
Reader = Callable[[SparkSession, Type, dict, list[str]], DataFrame]


def _text(make: Callable[..., text.TextAdapter], **names: str) -> Reader:
    def read(spark: SparkSession, model: Type, config: dict, uris: list[str]) -> DataFrame:
        named = {"delimiter": "delimiter", "skipLines": "skip_lines", "linesPerRecord": "lines_per_record", "dataMarker": "data_marker", "commentCharacter": "comment"} | names
        args = {arg: int(config[k]) if arg in ("skip_lines", "lines_per_record") else config[k] for k, arg in named.items() if k in config}
        return make(model, **args).read(spark, *uris)

    return read


#: Readers by the last part of an adapter's class name; more can be added under any name.
ADAPTERS: dict[str, Reader] = {
    "TextAdapter": _text(text.TextAdapter),
    "ColumnarAdapter": _text(text.ColumnarAdapter, columns="columns"),
    "RegexAdapter": _text(text.RegexAdapter, pattern="pattern", columns="columns"),
    "FormattedTextAdapter": _text(text.FormattedAdapter, format="format"),
    "SubstringAdapter": _text(text.SubstringAdapter, substring="substring"),
    "MatrixTextAdapter": _text(text.TextAdapter),
    "BinaryAdapter": lambda spark, model, config, uris: files.binary_records(spark, model, uris[0]),
    "FileListAdapter": lambda spark, model, c, uris: files.file_list(spark, model, uris[0], c["pattern"], c.get("columns"), c.get("baseDir")),
    "GranuleListGenerator": lambda spark, model, c, _: files.granule_list(spark, model, c["start"], c["step"], c["pattern"], c.get("end")),
    "JdbcAdapter": lambda spark, model, c, uris: files.jdbc(spark, model, uris[0], c["table"], c.get("predicate"), int(c.get("fetchSize", 8192)), **{k: c[k] for k in ("driver", "user", "password") if k in c}),
    "NetcdfAdapter": lambda spark, model, c, uris: _netcdf(spark, model, uris[0]).source(),
    "MockAdapter": lambda spark, model, c, _: spark.createDataFrame([(0, 0), (1, 2), (2, 4)], ", ".join(f"`{s.id}` int" for s in [model.domain, model.range])),
}


def _netcdf(spark: SparkSession, model: Type, path: str) -> Dataset:
    from funcframe.sources.netcdf import Netcdf

    return Netcdf.of_file("file", model, path, spark)


#: Readers of whole datasets by the ending of a URI; more can be added.
READERS: dict[str, Callable[[str, SparkSession], Dataset]] = {}


def open_dataset(uri: str, spark: SparkSession) -> Dataset:
    """The dataset that the reader for a URI's ending makes of it."""
    for ending, make in READERS.items():
        if uri.endswith(ending):
            return make(uri, spark)
    raise ModelError(f"No reader for {uri}")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _type(e: ET.Element) -> Type:
    kind, a = _local(e.tag), dict(e.attrib)
    kids = [k for k in e if isinstance(k.tag, str)]
    if kind == "scalar":
        if "id" not in a or "type" not in a:
            raise ModelError("A scalar needs an id and a type")
        id, type_, cls = a.pop("id"), a.pop("type"), a.pop("class", "")
        if cls.endswith("Index"):
            return Index(id, "long", a)
        if cls and not cls.endswith("Time"):
            raise ModelError(f"Unsupported class: {cls}")
        if cls and "units" not in a:
            raise ModelError("A time needs units")
        return Scalar(id, type_, a, bool(cls))
    if kind == "tuple":
        return Tuple(tuple(map(_type, kids)), a.get("id", ""))
    if kind == "function":
        if len(kids) != 2:
            raise ModelError("A function needs a domain and a range")
        return Function(_type(kids[0]), _type(kids[1]), a.get("id", ""))
    raise ModelError(f"Unexpected element: {kind}")


def parse(body: str | bytes, spark: SparkSession, base: str = "") -> Dataset:
    """A dataset of one description. Relative URIs count from ``base``."""
    try:
        root = ET.fromstring(body, ET.XMLParser(target=ET.TreeBuilder(insert_pis=True)))
    except ET.ParseError as e:
        raise ModelError(f"Failed to parse XML: {e}") from None
    return _dataset(root, spark, base)


def _dataset(root: ET.Element, spark: SparkSession, base: str) -> Dataset:
    if _local(root.tag) != "dataset" or "id" not in root.attrib:
        raise ModelError("A description is a dataset with an id")
    kids = {}
    operations = []
    for e in root:
        if e.tag is ET.ProcessingInstruction:
            name, _, rest = (e.text or "").partition(" ")
            if name.endswith("operation") and 'expression="' in rest:
                operations += ops.from_expression(rest.split('expression="', 1)[1].rsplit('"', 1)[0].replace("&gt;", ">").replace("&lt;", "<").replace("&amp;", "&").replace("&quot;", '"'), keep_quotes=True)
        elif isinstance(e.tag, str):
            if _local(e.tag) in kids:
                raise ModelError(f"More than one {_local(e.tag)}")
            kids[_local(e.tag)] = e
    if "adapter" not in kids or "class" not in kids["adapter"].attrib:
        raise ModelError("A description needs an adapter with a class")
    if "function" not in kids:
        raise ModelError("A description needs one function")
    config = dict(kids["adapter"].attrib)
    name = config.pop("class").rpartition(".")[2]
    if name not in ADAPTERS:
        raise ModelError(f"Unknown adapter: {name}")
    model, read = _type(kids["function"]), ADAPTERS[name]
    meta = {k: v for k, v in root.attrib.items() if k not in ("class",)}
    resolve = lambda u: u if "://" in u or os.path.isabs(u) or u.startswith("jdbc:") else os.path.join(base, u)
    if "dataset" in kids:
        listed = _dataset(kids["dataset"], spark, base)
        out = granules(root.attrib["id"], listed, lambda uris: read(spark, model, config, [resolve(u) for u in uris]), model)
    else:
        if name == "NetcdfAdapter" and "source" in kids:
            from dataclasses import replace

            return replace(_netcdf(spark, model, resolve(kids["source"].attrib["uri"])), id=root.attrib["id"], metadata=meta).with_operations(operations)
        if "source" not in kids or "uri" not in kids["source"].attrib:
            raise ModelError("A description needs a source with a uri")
        uri = resolve(kids["source"].attrib["uri"])
        out = Dataset(root.attrib["id"], model, lambda: read(spark, model, config, [uri]), (), meta)
    return out.with_operations(operations)


def read(path: str, spark: SparkSession) -> Dataset:
    with open(path, "rb") as f:
        return parse(f.read(), spark, os.path.dirname(os.path.abspath(path)))


READERS[".fdml"] = read


@dataclass
class Catalog:
    """Datasets by id, and catalogs within catalogs by names with dots."""

    datasets: dict[str, Dataset] = field(default_factory=dict)
    catalogs: dict[str, Catalog] = field(default_factory=dict)

    @classmethod
    def of_folder(cls, folder: str, spark: SparkSession) -> Catalog:
        """All readable descriptions of a folder; a bad one is left out with a warning. Folders within become catalogs."""
        out = cls()
        for name in sorted(os.listdir(folder)):
            path = os.path.join(folder, name)
            if os.path.isdir(path):
                out.catalogs[name] = cls.of_folder(path, spark)
            elif name.endswith(".fdml"):
                try:
                    ds = read(path, spark)
                    out.datasets[ds.id] = ds
                except ModelError as e:
                    log.warning("%s: %s", name, e)
        return out

    def find(self, id: str) -> Dataset | None:
        if id in self.datasets:
            return self.datasets[id]
        head, _, rest = id.partition(".")
        return self.catalogs[head].find(rest) if rest and head in self.catalogs else None

    def find_catalog(self, id: str) -> Catalog | None:
        head, _, rest = id.partition(".")
        found = self.catalogs.get(head)
        return found.find_catalog(rest) if found and rest else found

    def filter(self, keep: Callable[[Dataset], bool]) -> Catalog:
        return Catalog({k: d for k, d in self.datasets.items() if keep(d)}, {k: c.filter(keep) for k, c in self.catalogs.items()})

    def merged(self, other: Catalog) -> Catalog:
        return Catalog(other.datasets | self.datasets, other.catalogs | self.catalogs)

    def listing(self, depth: int | None = None) -> dict:
        """As plain data, sorted by id."""
        out: dict = {"dataset": [{"identifier": k, "title": d.metadata.get("title", k)} for k, d in sorted(self.datasets.items())]}
        if depth is None or depth > 0:
            out["catalog"] = [{"identifier": k} | c.listing(None if depth is None else depth - 1) for k, c in sorted(self.catalogs.items())]
        return out
