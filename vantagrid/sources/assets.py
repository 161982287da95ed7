"""Mesh files: what a PLY file holds, and triangles out of PLY and glTF files.

A file is one task's work, and its triangles leave the task in batches.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAD = 4096
BATCH = 1 << 16
# Properties that only captures of Gaussians have, and PLY's and glTF's number types.
CAPTURE_PROPERTIES = ["f_dc_0", "scale_0", "rot_0", "opacity"]
PLY_TYPES = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
GLTF_TYPES = {5120: "i1", 5121: "u1", 5122: "i2", 5123: "u2", 5125: "u4", 5126: "f4"}

SCHEMA = "path string, tri_id long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, problem string"


def ply_kind(content: Column) -> Column:
    """``splat``, ``mesh``, ``points`` or ``unreadable``, by the header within the first 4096 bytes."""
    text = F.regexp_replace(F.decode(F.substring(content, 1, HEAD), "ISO-8859-1"), "^ï»¿", "")
    lines = F.transform(F.split(text, "\r?\n"), lambda s: F.regexp_replace(s, "^\\s+|\\s+$", ""))
    end = F.array_position(lines, "end_header")
    words = F.transform(F.slice(lines, 2, F.greatest(end - 2, F.lit(0)).cast("int")), lambda s: F.split(s, "\\s+"))
    capture = F.exists(words, lambda w: (F.get(w, 0) == "property") & F.element_at(w, -1).isin(CAPTURE_PROPERTIES))
    faces = F.exists(words, lambda w: (F.get(w, 0) == "element") & F.coalesce(F.get(w, 1) == "face", F.lit(False)))
    readable = (F.get(lines, 0) == "ply") & (end > 0)
    kind = F.when(capture, "splat").when(faces, "mesh").otherwise("points")
    return F.when(F.coalesce(readable, F.lit(False)), kind).otherwise("unreadable")


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """Triangles of all .ply, .glb and .gltf files under a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return decode_meshes(files.where(F.lower("path").rlike("[.](ply|glb|gltf)$")))


def decode_meshes(files: DataFrame) -> DataFrame:
    """Triangles of files (path, content), numbered from 0 in each; a file that gives none has one row with the ``problem``."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for path, content in zip(batch["path"], batch["content"]):
                for part in _parts(path.as_py(), content.as_py()):
                    held.append(part)
                    n += max(1, len(part[2]))
                    if n >= BATCH:
                        yield _together(held)
                        held, n = [], 0
            if held:
                yield _together(held)

    return files.select("path", "content").mapInArrow(decode, SCHEMA)


def _parts(path: str | None, content: bytes | None) -> Iterator[tuple[str | None, int, np.ndarray, str | None]]:
    """A file's path, the number of the first triangle, the triangles, ``BATCH`` at most, and the problem, where there are none."""
    try:
        corners = triangles_of(content or b"")
        problem = None if len(corners) else "no faces"
    except (ValueError, KeyError, IndexError, TypeError, struct.error) as error:
        corners, problem = np.zeros((0, 9)), f"unreadable: {error}"
    for start in range(0, max(1, len(corners)), BATCH):
        yield path, start, corners[start : start + BATCH], problem


def _together(parts: list[tuple[str | None, int, np.ndarray, str | None]]) -> pa.RecordBatch:
    """One batch of many parts: a batch costs more to make than a small file to read."""
    paths, starts, corners, problems = zip(*parts)
    counts = [max(1, len(c)) for c in corners]
    of = np.repeat(np.arange(len(parts)), counts)
    none = np.array([p is not None for p in problems])[of]
    every = np.concatenate([np.asarray(c, "f8") if len(c) else np.zeros((1, 9)) for c in corners])
    numbers = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, counts)])
    columns = [pa.array(paths, pa.string()).take(pa.array(of)), pa.array(numbers, pa.int64(), mask=none)]
    columns += [pa.array(np.ascontiguousarray(every[:, k]), pa.float64(), mask=none, from_pandas=False) for k in range(9)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(problems, pa.string()).take(pa.array(of))], ["path", "tri_id", *(f"{n}{a}" for n in "abc" for a in "xyz"), "problem"])


def triangles_of(content: bytes) -> np.ndarray:
    """The nine coordinates of every triangle, by the file's first bytes."""
    if content[:4] == b"glTF":
        return _glb(content)
    if content.lstrip()[:1] == b"{":
        return _gltf(json.loads(content), None)
    return _ply(content)


def _corners(points: np.ndarray, faces: np.ndarray) -> np.ndarray:
    if len(faces) and (faces.min() < 0 or faces.max() >= len(points)):
        raise ValueError("a face names a vertex that isn't there")
    return points[faces].reshape(-1, 9)


def _fan(sides: list[np.ndarray]) -> np.ndarray:
    """Triangles around the first corner of each polygon, in the order of the polygons."""
    fans = [np.stack([np.full(len(s) - 2, s[0]), s[1:-1], s[2:]], 1) for s in sides if len(s) > 2]
    return np.concatenate(fans) if fans else np.zeros((0, 3), "i8")


def _ply(content: bytes) -> np.ndarray:
    content = content.removeprefix(b"\xef\xbb\xbf")
    if content[:3] != b"ply" or b"end_header" not in content:
        raise ValueError("no PLY header")
    head, _, body = content.partition(b"end_header")
    body = body[body.index(b"\n") + 1 :] if b"\n" in body else b""
    order, elements = None, []
    for words in (line.split() for line in head.decode("latin-1").splitlines()):
        if words[:1] == ["format"]:
            order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[words[1]]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(tuple(words[1:]))
    if order is None:
        raise ValueError("no PLY format")
    take = _words(body) if order == "" else _bytes(body, order)
    points, faces = np.zeros((0, 3)), np.zeros((0, 3), "i8")
    for name, count, properties in elements:
        values = take(count, properties)
        if name == "vertex":
            points = np.stack([np.asarray(values[a], "f8") for a in "xyz"], 1)
        elif name == "face":
            faces = _fan([np.asarray(s, "i8") for s in values.get("vertex_indices", values.get("vertex_index", []))])
    return _corners(points, faces)


def _words(body: bytes):
    words, at = body.split(), 0

    def take(count: int, properties: list[tuple]) -> dict[str, list]:
        nonlocal at
        found: dict[str, list] = {p[-1]: [] for p in properties}
        if at + count > len(words) and properties:
            raise ValueError("fewer values than the header tells")
        for _ in range(count):
            for p in properties:
                if p[0] == "list":
                    n = int(words[at])
                    found[p[-1]].append([int(w) for w in words[at + 1 : at + 1 + n]])
                    at += n + 1
                else:
                    found[p[-1]].append(float(words[at]))
                    at += 1
        return found

    return take


def _bytes(body: bytes, order: str):
    at = 0

    def take(count: int, properties: list[tuple]) -> dict[str, list]:
        nonlocal at
        if all(p[0] != "list" for p in properties):
            kind = np.dtype([(p[1], order + PLY_TYPES[p[0]]) for p in properties])
            rows = np.frombuffer(body, kind, count, at)
            at += count * kind.itemsize
            return {p[1]: rows[p[1]] for p in properties}
        found: dict[str, list] = {p[-1]: [] for p in properties}
        for _ in range(count):
            for p in properties:
                if p[0] == "list":
                    size, item = (np.dtype(order + PLY_TYPES[t]) for t in p[1:3])
                    n = int(np.frombuffer(body, size, 1, at)[0])
                    found[p[-1]].append(np.frombuffer(body, item, n, at + size.itemsize))
                    at += size.itemsize + n * item.itemsize
                else:
                    kind = np.dtype(order + PLY_TYPES[p[0]])
                    found[p[-1]].append(np.frombuffer(body, kind, 1, at)[0])
                    at += kind.itemsize
        return found

    return take


def _glb(content: bytes) -> np.ndarray:
    document, binary, at = None, None, 12
    while at + 8 <= len(content):
        size, kind = struct.unpack_from("<II", content, at)
        chunk = content[at + 8 : at + 8 + size]
        if kind == 0x4E4F534A:
            document = json.loads(chunk)
        elif kind == 0x004E4942 and binary is None:
            binary = chunk
        at += 8 + size
    if document is None:
        raise ValueError("no JSON chunk")
    return _gltf(document, binary)


def _gltf(document: dict, binary: bytes | None) -> np.ndarray:
    """Triangles of all meshes below the scene's nodes, moved by the nodes; buffers lie in the file itself."""
    buffers = []
    for i, buffer in enumerate(document.get("buffers", [])):
        uri = buffer.get("uri")
        if uri is None and i == 0 and binary is not None:
            buffers.append(binary)
        elif uri and uri.startswith("data:"):
            buffers.append(base64.b64decode(uri.split(",", 1)[1]))
        else:
            raise ValueError("a buffer lies outside of the file")

    def values(index: int, width: int) -> np.ndarray:
        spec = document["accessors"][index]
        kind, n = np.dtype("<" + GLTF_TYPES[spec["componentType"]]), spec["count"]
        if "bufferView" not in spec:
            return np.zeros((n, width), kind)
        view = document["bufferViews"][spec["bufferView"]]
        start, step = view.get("byteOffset", 0) + spec.get("byteOffset", 0), view.get("byteStride", width * kind.itemsize)
        data = buffers[view["buffer"]]
        if start + (n - 1) * step + width * kind.itemsize > len(data):
            raise ValueError("an accessor reaches behind its buffer")
        return np.ndarray((n, width), kind, data, start, (step, kind.itemsize))

    found, nodes = [np.zeros((0, 9))], document.get("nodes", [])
    scenes = document.get("scenes", [])
    below = {c for node in nodes for c in node.get("children", [])}
    roots = scenes[document.get("scene", 0)].get("nodes", []) if scenes else [i for i in range(len(nodes)) if i not in below]
    waiting = [(i, np.eye(4)) for i in reversed(roots)]
    visited = 0
    while waiting:
        index, above = waiting.pop()
        visited += 1
        if visited > len(nodes):
            raise ValueError("nodes form no tree")
        node = nodes[index]
        world = above @ _matrix(node)
        waiting += [(c, world) for c in reversed(node.get("children", []))]
        for part in document["meshes"][node["mesh"]]["primitives"] if "mesh" in node else []:
            if part.get("mode", 4) != 4:
                continue
            points = values(part["attributes"]["POSITION"], 3).astype("f8") @ world[:3, :3].T + world[:3, 3]
            order = values(part["indices"], 1)[:, 0].astype("i8") if "indices" in part else np.arange(len(points))
            found.append(_corners(points.astype("f4").astype("f8"), order[: len(order) // 3 * 3].reshape(-1, 3)))
    return np.concatenate(found)


def _matrix(node: dict) -> np.ndarray:
    if "matrix" in node:
        return np.array(node["matrix"], "f8").reshape(4, 4).T
    x, y, z, w = node.get("rotation", [0, 0, 0, 1])
    turn = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    out = np.eye(4)
    out[:3, :3] = turn * np.array(node.get("scale", [1, 1, 1]), "f8")
    out[:3, 3] = node.get("translation", [0, 0, 0])
    return out
