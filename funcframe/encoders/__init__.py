"""Datasets as text, JSON lines, bytes, archives, events and descriptions.

Encoders stream samples through the driver row by row, as one response has to; :func:`write_csv` and the module
``parallel`` encode and write with all tasks.
"""

from __future__ import annotations

import html
import json
import math
import queue
import tempfile
import threading
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from funcframe.dataset import Dataset
from funcframe.model import Function, Index, ModelError, Scalar, Tuple, Type, col, column_id, columns, domain, elements, range_, scalars
from funcframe.operators import Uncurry


def _flat(ds: Dataset) -> Dataset:
    nested = [e for e in range_(ds.model) if isinstance(e, Function)]
    if any(isinstance(x, Function) for e in nested for x in elements(e.range)) or len(nested) > 1:
        raise ModelError("The dataset is too complex for this form")
    return ds.with_operation(Uncurry()) if nested else ds


def _shown(v: object, s: Scalar) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        if "precision" in s.meta and math.isfinite(v):
            return f"{v:.{int(s.meta['precision'])}f}"
        return "NaN" if math.isnan(v) else ("Infinity" if v > 0 else "-Infinity") if math.isinf(v) else _real(v)
    return str(v)


def _real(v: float) -> str:
    """Shortest digits; an exponent below a thousandth and from ten million up."""
    if v == 0 or 1e-3 <= abs(v) < 1e7:
        return repr(v) if "e" not in repr(v) else f"{v:f}"
    digits, _, exponent = f"{v:.17e}".partition("e")
    for n in range(17):
        digits, _, exponent = f"{v:.{n}e}".partition("e")
        if float(f"{digits}e{exponent}") == v:
            break
    return f"{digits if '.' in digits else digits + '.0'}E{int(exponent)}"


def _quoted(text: str) -> str:
    return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\r\n') else text


def csv(ds: Dataset, header: bool = True) -> Iterator[str]:
    """Lines that end with CR LF; an index is left out."""
    flat = _flat(ds)
    cols = [s for s in scalars(flat.model) if not isinstance(s, Index)]
    if header:
        yield ",".join(s.id for s in cols) + "\r\n"
    for r in flat.samples().toLocalIterator():
        yield ",".join(_quoted(_shown(v, s)) for v, s in zip(r, cols, strict=True)) + "\r\n"


def write_csv(ds: Dataset, path: str) -> None:
    """In parallel, in range partitions that keep the order."""
    flat = _flat(ds)
    df = flat.samples()
    for s in scalars(flat.model):
        if "precision" in s.meta:
            df = df.withColumn(s.id, F.format_string(f"%.{int(s.meta['precision'])}f", col(s.id)))
    df.write.option("header", True).option("lineSep", "\r\n").csv(path)


def _json(v: object) -> object:
    if isinstance(v, float):
        return v if math.isfinite(v) else None
    if isinstance(v, Row):
        return [_json(x) for x in v]
    if isinstance(v, list):
        return [_json(x) for x in v]
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


def json_lines(ds: Dataset) -> Iterator[str]:
    """An array for each sample; NaN is null; precision does not matter."""
    for r in ds.samples().toLocalIterator():
        yield json.dumps([_json(v) for v in r], ensure_ascii=False, separators=(",", ":")) + "\n"


def metadata(ds: Dataset) -> str:
    out = {"id": ds.id} | ds.metadata | ({"history": ds.history} if ds.history else {})
    out |= {"model": str(ds.model), "variable": [{"id": s.id, "type": s.type} | ({"class": "time"} if s.is_time else {}) | s.meta for s in scalars(ds.model)]}
    return json.dumps(out, ensure_ascii=False, default=str)


def text(ds: Dataset) -> Iterator[str]:
    """``domain -> range`` for each sample, nested functions indented within braces; indexes count from 0."""
    m = ds.model
    yield f"{ds.id}: {m}\n"

    def value(t: Type, row: Iterator, depth: int) -> str:
        if isinstance(t, Tuple):
            return "(" + ", ".join(value(e, row, depth) for e in t.elements) + ")"
        if isinstance(t, Function):
            return "{\n" + "".join("  " * (depth + 1) + sample(t, iter(r), i, depth + 1) + "\n" for i, r in enumerate(next(row) or [])) + "  " * depth + "}"
        return _shown(next(row), t)

    def sample(f: Type, row: Iterator, n: int, depth: int) -> str:
        if not isinstance(f, Function):
            return value(f, row, depth)
        d = [str(n) if isinstance(s, Index) else _shown(next(row), s) for s in elements(f.domain)]
        left = d[0] if len(d) == 1 else "(" + ", ".join(d) + ")"
        return f"{left} -> {value(f.range, row, depth)}"

    for i, r in enumerate(ds.samples().toLocalIterator()):
        yield sample(m, iter(r), i, 0) + "\n"


def binary(ds: Dataset) -> Iterator[bytes]:
    """Big-endian records of fixed width, packed by tasks, a run of samples at a time."""
    from funcframe.encoders.parallel import binary_blocks

    for (body,) in binary_blocks(ds).toLocalIterator():
        yield bytes(body)


def write_archive(ds: Dataset, out) -> None:
    """A ZIP file of a dataset ``name -> bytes`` to a binary file; one entry is held at a time."""
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in ds.samples().toLocalIterator():
            z.writestr(name, bytes(body))


def archive(ds: Dataset) -> Iterator[bytes]:
    """The bytes of :func:`write_archive`, by way of a file on disk."""
    with tempfile.TemporaryFile() as held:
        write_archive(ds, held)
        held.seek(0)
        while part := held.read(1 << 20):
            yield part


def netcdf(ds: Dataset) -> Iterator[bytes]:
    """The bytes of a netCDF file of a Cartesian dataset, by way of a file on the driver's disk."""
    from funcframe.sources.netcdf import write

    with tempfile.NamedTemporaryFile() as held:
        write(ds, held.name)
        while part := held.read(1 << 20):
            yield part


#: Seconds without an event after which an empty comment is sent.
HEARTBEAT = 30.0


def events(ds: Dataset, chunk: int = 100, heartbeat: float | None = None) -> Iterator[str]:
    """Server-sent events: metadata, data in chunks, or an error; an empty comment every ``heartbeat`` seconds meanwhile."""
    made: queue.Queue = queue.Queue(maxsize=8)
    gone = threading.Event()

    def put(text: str | None) -> bool:
        while not gone.is_set():
            try:
                made.put(text, timeout=1)
                return True
            except queue.Full:
                continue
        return False

    def work() -> None:
        try:
            put(f"event: metadata\ndata: {metadata(ds)}\n\n")
            held: list[str] = []
            for line in json_lines(ds):
                held.append(line.strip())
                if len(held) == chunk:
                    if not put(f'event: data\ndata: {{"data":[{",".join(held)}]}}\n\n'):
                        return
                    held = []
            if held:
                put(f'event: data\ndata: {{"data":[{",".join(held)}]}}\n\n')
        except ModelError as e:
            put(f"event: error\ndata: {json.dumps({'message': str(e)})}\n\n")
        except Exception:  # noqa: BLE001  what Spark says may hold paths
            put(f"event: error\ndata: {json.dumps({'message': 'unspecified error'})}\n\n")
        put(None)

    threading.Thread(target=work, daemon=True).start()
    try:
        while True:
            try:
                text = made.get(timeout=HEARTBEAT if heartbeat is None else heartbeat)
            except queue.Empty:
                yield ":\n\n"
                continue
            if text is None:
                return
            yield text
    finally:
        gone.set()


#: Names of types in the declaration language; others have none.
DAP_TYPES = {"byte": "Byte", "short": "Int16", "int": "Int32", "float": "Float32", "double": "Float64", "string": "String"}


def _dap(s: Scalar) -> str:
    if s.kind not in DAP_TYPES:
        raise ModelError(f"Unsupported type: {s.type}")
    return DAP_TYPES[s.kind]


def dds(ds: Dataset) -> str:
    """The declaration of the dataset's types."""

    def one(t: Type, pad: str) -> str:
        if isinstance(t, Function):
            inner = "".join(one(e, pad + "  ") for e in (t.domain, t.range))
            return f"{pad}Sequence {{\n{inner}{pad}}} {t.id or 'samples'};\n"
        if isinstance(t, Tuple):
            return f"{pad}Structure {{\n" + "".join(one(e, pad + "  ") for e in t.elements) + f"{pad}}} {t.id or 'unknown'};\n" if t.id else "".join(one(e, pad) for e in t.elements)
        return f"{pad}{_dap(t)} {t.id};\n"

    return "Dataset {\n" + one(ds.model, "  ") + f"}} {ds.id};\n"


def das(ds: Dataset) -> str:
    """The attributes of each variable."""
    out = "Attributes {\n"
    for s in scalars(ds.model):
        out += f"  {s.id} {{\n" + "".join(f'    String {k} "{str(v).replace(chr(34), chr(92) + chr(34))}";\n' for k, v in s.meta.items()) + "  }\n"
    return out + "}\n"


def html_catalog(listing: dict, title: str = "Datasets") -> str:
    def items(node: dict) -> str:
        rows = "".join(f'<li><a href="{html.escape(d["identifier"])}.meta">{html.escape(str(d["title"]))}</a></li>' for d in node["dataset"])
        return "<ul>" + rows + "".join(f"<li>{html.escape(c['identifier'])}{items(c)}</li>" for c in node.get("catalog", [])) + "</ul>"

    return f"<!DOCTYPE html><html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{items(listing)}</body></html>"


#: By the extension of a request.
BY_EXTENSION = {
    "csv": ("text/csv", csv), "txt": ("text/plain", lambda ds: csv(ds, header=False)), "jsonl": ("application/jsonl", json_lines), "meta": ("application/json", lambda ds: [metadata(ds)]), "asc": ("text/plain", text),
    "bin": ("application/octet-stream", binary), "zip": ("application/zip", archive), "nc": ("application/netcdf", netcdf), "sse": ("text/event-stream", events), "dds": ("text/plain", lambda ds: [dds(ds)]), "das": ("text/plain", lambda ds: [das(ds)]),
}

__all__ = ["BY_EXTENSION", "DataFrame", "archive", "binary", "column_id", "columns", "csv", "das", "dds", "domain", "events", "html_catalog", "json_lines", "metadata", "netcdf", "text", "write_archive", "write_csv"]
