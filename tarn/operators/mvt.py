"""Vector tiles: encoding of a tile's features as protocol buffers, and an independent decoder."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarn.functions.geo import MVT_EXTENT
from tarn.operators.kernels import away, bounds

#: Layer names by number (fixed values); lower numbers win where a way has several of their keys.
LAYERS = ("highway", "waterway", "natural", "landuse")
POI_BIT = 1 << 63


def varint(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, where it ends); at most ten bytes and 64 bits, else an error."""
    value = 0
    for k in range(10):
        if at + k >= len(raw):
            raise ValueError("varint is cut off")
        b = raw[at + k]
        value |= (b & 0x7F) << (7 * k)
        if b < 0x80:
            if value >> 64:
                raise ValueError("varint exceeds 64 bits")
            return value, at + k + 1
    raise ValueError("varint is too long")


def zigzag(v: int) -> int:
    return v << 1 if v >= 0 else (-v << 1) - 1


def unzigzag(v: int) -> int:
    return v >> 1 if not v & 1 else -((v + 1) >> 1)


def delta_bytes(values: list[int]) -> bytes:
    """Ids as zigzag varints of their differences."""
    return b"".join(varint(zigzag(b - a)) for a, b in zip([0, *values], values, strict=False))


def undelta_bytes(raw: bytes) -> list[int]:
    out, at, now = [], 0, 0
    while at < len(raw):
        v, at = read_varint(raw, at)
        now += unzigzag(v)
        if not 0 <= now < 1 << 63:
            raise ValueError("id out of range")
        out.append(now)
    return out


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


#: Varints of small numbers.
_SMALL = [bytes([v]) if v < 128 else bytes([v & 127 | 128, v >> 7]) for v in range(1 << 14)]


def packed(values: list[int]) -> bytes:
    """Varints one after another."""
    return b"".join([_SMALL[v] if v < 16384 else varint(v) for v in values])


def grid(points: np.ndarray, z: int, x: int, y: int) -> np.ndarray:
    left, low, right, top = bounds(z, x, y)
    scale = MVT_EXTENT / (right - left)
    return np.stack([away((points[:, 0] - left) * scale), away((top - points[:, 1]) * scale)], 1)


def commands(segments: list) -> tuple[int, list[int]]:
    """(geometry type, command integers) of segments in grid units, arrays or lists of pairs.

    All segments of one vertex make a point, without repeats; others lines, without consecutive repeats and without
    lines that shrink to a point.  Type 0: nothing is left.
    """
    lines = [s.tolist() if isinstance(s, np.ndarray) else s for s in segments]
    if lines and all(len(s) == 1 for s in lines):
        points = list(dict.fromkeys((x, y) for ((x, y),) in lines))
        out, ax, ay = [1 | len(points) << 3], 0, 0
        for x, y in points:
            out += [zigzag(x - ax), zigzag(y - ay)]
            ax, ay = x, y
        return 1, out
    out, ax, ay = [], 0, 0
    for s in lines:
        steps, bx, by = [], *s[0]
        for x, y in s:
            dx, dy = x - bx, y - by
            if dx or dy:
                steps.append(dx << 1 if dx >= 0 else (-dx << 1) - 1)
                steps.append(dy << 1 if dy >= 0 else (-dy << 1) - 1)
                bx, by = x, y
        if steps:
            x, y = s[0]
            out += [9, zigzag(x - ax), zigzag(y - ay), 2 | len(steps) // 2 << 3]
            out += steps
            ax, ay = bx, by
    return (2, out) if out else (0, [])


def packed_all(values: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): varints of non-negative integers one after another, and where the given positions are in bytes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >> (7 * k) > 0
        if not more.any():
            break
        size += more
    at = np.concatenate(([0], np.cumsum(size)))
    out = np.empty(at[-1], np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[at[:-1][has] + k] = (values[has] >> (7 * k) & 0x7F).astype(np.uint8) | np.where(size[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out, at[cuts]


def _zigzag_all(v: np.ndarray) -> np.ndarray:
    return (v << 1) ^ (v >> 63)


def geometries(rows: np.ndarray, cuts: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(types, offsets, bytes) of what `commands` gives for many features at once, packed.

    Feature k has the segments rows[k]..rows[k + 1], segment r the points cuts[r]..cuts[r + 1] in grid units.
    """
    features, runs = len(rows) - 1, len(cuts) - 1
    sizes = np.diff(cuts)
    own = np.repeat(np.arange(features), np.diff(rows))
    single = np.bincount(own, sizes == 1, features) == np.diff(rows)
    step_x, step_y = np.diff(gx, prepend=0), np.diff(gy, prepend=0)
    moves = (step_x != 0) | (step_y != 0)
    moves[cuts[:-1][sizes > 0]] = False
    upto = np.concatenate(([0], np.cumsum(moves)))
    steps = upto[cuts[1:]] - upto[cuts[:-1]]
    drawn = np.flatnonzero((steps > 0) & ~single[own])
    # Each drawn segment begins where the one before it in its feature ended.
    first, last = cuts[drawn], cuts[drawn + 1] - 1
    follows = np.zeros(len(drawn), bool)
    follows[1:] = own[drawn[1:]] == own[drawn[:-1]]
    before = np.append(0, last[:-1]) if len(drawn) else last
    count = np.zeros(runs, np.int64)
    count[drawn] = 4 + 2 * steps[drawn]
    at = np.concatenate(([0], np.cumsum(count)))
    values = np.empty(at[-1], np.int64)
    head = at[drawn]
    values[head] = 9
    values[head + 1] = _zigzag_all(gx[first] - np.where(follows, gx[before], 0))
    values[head + 2] = _zigzag_all(gy[first] - np.where(follows, gy[before], 0))
    values[head + 3] = 2 | steps[drawn] << 3
    run_of = np.repeat(np.arange(runs), sizes)
    inside = np.flatnonzero(moves & (count[run_of] > 0))
    place = at[run_of[inside]] + 4 + 2 * (upto[inside] - upto[cuts[run_of[inside]]])
    values[place], values[place + 1] = _zigzag_all(step_x[inside]), _zigzag_all(step_y[inside])
    raw, ends = packed_all(values, at[rows])
    kinds = np.where(np.diff(ends) > 0, 2, 0).astype(np.int32)
    points = np.flatnonzero(single & (np.diff(rows) > 0))
    if not len(points):
        return kinds, ends, raw
    parts = [raw[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    for k in points.tolist():
        kinds[k], numbers = commands([[(int(gx[c]), int(gy[c]))] for c in cuts[rows[k] : rows[k + 1]].tolist()])
        parts[k] = packed(numbers)
    return kinds, np.concatenate(([0], np.cumsum([len(x) for x in parts]))), np.frombuffer(b"".join(parts), np.uint8)


def geometry(segments: list[np.ndarray], z: int, x: int, y: int) -> tuple[int, bytes]:
    """(type, packed commands) of a feature's segments in metres; type 0: nothing is left to draw."""
    kind, numbers = commands([grid(np.asarray(s, float).reshape(-1, 2), z, x, y) for s in segments])
    return kind, packed(numbers)


class Tile:
    """A tile that features are added to, in order of their ids."""

    def __init__(self):
        self.layers: dict[int, tuple[dict, dict, list]] = {}

    def add(self, is_poi: bool, osm_id: int, layer: int, kind: int, geometry: bytes, tags: tuple[str | None, ...]) -> None:
        """``tags`` are class, sac_scale and name; of them only the class may be empty."""
        own = self.layers.get(layer)
        if own is None:
            own = self.layers[layer] = ({"class": 0}, {}, [])
        keys, values, features = own
        numbers = [0, values.setdefault(tags[0] or "", len(values))]
        for key, value in zip(("sac_scale", "name"), tags[1:], strict=True):
            if value:
                numbers += [keys.setdefault(key, len(keys)), values.setdefault(value, len(values))]
        features.append(field(2, field(1, osm_id | POI_BIT if is_poi else osm_id) + field(2, packed(numbers)) + field(3, kind) + field(4, geometry)))

    def encode(self) -> bytes | None:
        """None if no feature was added."""
        out = b""
        for k in sorted(self.layers):
            keys, values, features = self.layers[k]
            body = field(1, LAYERS[k].encode()) + b"".join(features) + b"".join(field(3, s.encode()) for s in keys) + b"".join(field(4, field(1, s.encode())) for s in values) + field(5, MVT_EXTENT) + field(15, 2)
            out += field(3, body)
        return out or None


def varint_sizes(values: np.ndarray) -> np.ndarray:
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >> (7 * k) > 0
    return size


def _with_bytes(numbers: np.ndarray, cuts: np.ndarray, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of items: the varints numbers[cuts[k]:cuts[k + 1]], then raw[first[k]:first[k] + size[k]]."""
    head, at = packed_all(numbers, cuts)
    own = np.diff(at)
    offs = np.concatenate(([0], np.cumsum(own + size)))
    out = np.empty(offs[-1], np.uint8)
    out[np.arange(len(head)) + np.repeat(offs[:-1] - at[:-1], own)] = head
    before = np.cumsum(size) - size
    steps = np.arange(int(size.sum()))
    out[steps + np.repeat(offs[:-1] + own - before, size)] = raw[steps + np.repeat(first - before, size)]
    return out, offs


def _first_use(group: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each event's number of its code in its group, by first use; and the events of first use, by group and number."""
    if not len(code):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, number = np.unique(group * (int(code.max()) + 1) + code, return_index=True, return_inverse=True)
    order = np.lexsort((first, group[first]))
    mine = group[first][order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order)) - np.searchsorted(mine, mine)
    return place[number.reshape(-1)], first[order]


def _bytes_of(column: pa.Array, kind: pa.DataType) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings or binaries (null as empty), and where each begins and ends."""
    column = pc.fill_null(column.cast(kind), b"" if pa.types.is_large_binary(kind) else "")
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offs


_KEYS = ("class", "sac_scale", "name")


def tiles_of(tile: np.ndarray, columns: dict[str, pa.Array]) -> list[bytes | None]:
    """Encoded tiles 0, 1, ... of features given as columns (is_poi, osm_id, layer, kind, geometry and tags), the same as `Tile` makes.

    ``tile`` has the number of each feature's tile, ascending; features of a tile are in the order of their ids.  Keys
    and values get their numbers by sorting, and all features are put together at once; Python runs once a layer.
    """
    if not len(tile):
        return []
    count = int(tile[-1]) + 1
    layer = columns["layer"].to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((layer, tile))
    group = (tile * len(LAYERS) + layer)[order]
    poi = columns["is_poi"].to_numpy(zero_copy_only=False).astype(bool)[order]
    osm_id = columns["osm_id"].to_numpy(zero_copy_only=False).astype(np.uint64)[order] | np.where(poi, np.uint64(POI_BIT), np.uint64(0))
    kind = columns["kind"].to_numpy(zero_copy_only=False).astype(np.uint64)[order]
    n = len(order)
    # Every text has one number in all tiles of the batch.
    texts = [pc.fill_null(columns[c].cast(pa.large_string()), "").take(pa.array(order)) for c in _KEYS]
    words = pa.chunked_array(texts).combine_chunks()
    words = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64).reshape(3, n)
    there = np.stack([np.ones(n, bool), *(pc.greater(pc.binary_length(t), 0).to_numpy(zero_copy_only=False).astype(bool) for t in texts[1:])])
    feature, slot = np.nonzero(there.T)
    value, new_values = _first_use(group[feature], code[slot, feature])
    key, new_keys = _first_use(group[feature], slot)
    # The numbers before a feature's geometry: what it is, its size, id, tags, kind, and the geometry's size.
    raw, offs = _bytes_of(columns["geometry"], pa.large_binary())
    first, size = offs[:-1][order], np.diff(offs)[order]
    pairs = there.sum(0)
    tag_size = np.bincount(feature, varint_sizes(key) + varint_sizes(value), n).astype(np.int64)
    whole = 1 + varint_sizes(osm_id) + 1 + varint_sizes(tag_size) + tag_size + 1 + varint_sizes(kind) + 1 + varint_sizes(size) + size
    cuts = np.concatenate(([0], np.cumsum(10 + 2 * pairs)))
    numbers = np.empty(cuts[-1], np.uint64)
    at = cuts[:-1]
    for k, v in enumerate((2 << 3 | 2, whole, 1 << 3, osm_id, 2 << 3 | 2, tag_size)):
        numbers[at + k] = v
    place = at[feature] + 6 + 2 * (np.arange(len(feature)) - np.repeat(np.cumsum(pairs) - pairs, pairs))
    numbers[place], numbers[place + 1] = key, value
    for k, v in enumerate((3 << 3, kind, 4 << 3 | 2, size)):
        numbers[cuts[1:] - 4 + k] = v
    drawn, ends = _with_bytes(numbers, cuts, raw, first, size)
    # Values of each layer, each a message with one text.
    text, begin = _bytes_of(words.dictionary, pa.large_string())
    which = code[slot, feature][new_values]
    long = np.diff(begin)[which]
    inner = 1 + varint_sizes(long) + long
    four = np.stack([np.full(len(which), 4 << 3 | 2), inner, np.full(len(which), 1 << 3 | 2), long], 1).reshape(-1)
    valued, upto = _with_bytes(four, np.arange(0, 4 * len(which) + 1, 4), text, begin[:-1][which], long)
    drawn, valued = drawn.tobytes(), valued.tobytes()
    value_group, key_group, key_slot = group[feature][new_values], group[feature][new_keys], slot[new_keys]
    key_field = [field(3, k.encode()) for k in _KEYS]
    out: list[list[bytes]] = [[] for _ in range(count)]
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), n], strict=True):
        g = int(group[a])
        v0, v1 = np.searchsorted(value_group, (g, g + 1)).tolist()
        k0, k1 = np.searchsorted(key_group, (g, g + 1)).tolist()
        body = b"".join((field(1, LAYERS[g % len(LAYERS)].encode()), drawn[ends[a] : ends[b]], *(key_field[s] for s in key_slot[k0:k1].tolist()), valued[upto[v0] : upto[v1]], field(5, MVT_EXTENT), field(15, 2)))
        out[g // len(LAYERS)].append(field(3, body))
    return [b"".join(layers) or None for layers in out]


def assemble_tile(features: list[dict]) -> bytes | None:
    """A tile of features (is_poi, osm_id, layer, class, sac_scale, name, kind, geometry), or None if none has a geometry.

    Ways come before points of interest, each by id; layers by number; keys and values in order of first use.
    """
    tile = Tile()
    for f in sorted(features, key=lambda f: (bool(f["is_poi"]), f["osm_id"])):
        if f["kind"]:
            tile.add(bool(f["is_poi"]), f["osm_id"], f["layer"], f["kind"], f["geometry"], (f.get("class"), f.get("sac_scale"), f.get("name")))
    return tile.encode()


def encode_tile(z: int, x: int, y: int, features: list[dict]) -> bytes | None:
    """A tile of features with segments in metres."""
    made = []
    for f in features:
        kind, raw = geometry(f["segments"], z, x, y)
        made.append({**f, "kind": kind, "geometry": raw})
    return assemble_tile(made)


def fields(raw: bytes):
    """(number, value) of a message's fields; of wire types other than varint and bytes only fixed widths are passed over."""
    at = 0
    while at < len(raw):
        tag, at = read_varint(raw, at)
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            value, at = read_varint(raw, at)
        elif wire == 2:
            size, at = read_varint(raw, at)
            if at + size > len(raw):
                raise ValueError("field is cut off")
            value, at = raw[at : at + size], at + size
        elif wire in (1, 5):
            at += 8 if wire == 1 else 4
            continue
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def unpack(raw: bytes) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        v, at = read_varint(raw, at)
        out.append(v)
    return out


def decode_tile(raw: bytes) -> list[dict]:
    """Features of a tile, with layer name, tags, type and absolute grid coordinates by segment."""
    out = []
    for number, layer in fields(raw):
        if number != 3:
            continue
        parts: dict[int, list] = {}
        for k, v in fields(layer):
            parts.setdefault(k, []).append(v)
        keys = [k.decode() for k in parts.get(3, [])]
        values = [next(iter(fields(v)))[1].decode() for v in parts.get(4, [])]
        for f in parts.get(2, []):
            own = dict(fields(f))
            tags = unpack(own[2])
            out.append({"layer": parts[1][0].decode(), "id": own[1], "type": own[3], "tags": {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}, "segments": _absolute(unpack(own[4]))})
    return out


def _absolute(numbers: list[int]) -> list[list[tuple[int, int]]]:
    out: list[list[tuple[int, int]]] = []
    at, x, y = 0, 0, 0
    while at < len(numbers):
        kind, count = numbers[at] & 7, numbers[at] >> 3
        at += 1
        for _ in range(count):
            x, y = x + unzigzag(numbers[at]), y + unzigzag(numbers[at + 1])
            at += 2
            if kind == 1:
                out.append([])
            out[-1].append((x, y))
    return out
