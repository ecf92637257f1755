"""Character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "birth_date", "name")
#: O, then begin and inside of each kind.
TAGS = 1 + 2 * len(KINDS)
_ALPHABET = "абвгдежзийклмнопрстуфхцчшщъыьэюяё" + "abcdefghijklmnopqrstuvwxyz" + "0123456789" + " \n.,:;()-@+/_'\"<>[]№#%&*=|!?«»"
_CODE = {c: k + 3 for k, c in enumerate(_ALPHABET)}
SYMBOLS = len(_ALPHABET) + 3  # 0 pads, 1 is another letter, 2 anything else
_SAME = dict.fromkeys("              　\t\r", " ") | dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("“”„", '"')


class _Codes(dict):
    """Code point to symbol, plus SYMBOLS for capitals."""

    def __missing__(self, point: int) -> int:
        c = chr(point)
        c = _SAME.get(c, c)
        low = c.lower()
        code = _CODE.get(low)
        if code is None:
            folded = unicodedata.normalize("NFKC", low)[:1]
            code = _CODE.get(folded) or (1 if c.isalpha() else 2)
        value = code + (SYMBOLS if low != c else 0)
        if len(self) < 1 << 17:
            self[point] = value
        return value


_codes = _Codes()


@lru_cache(maxsize=1)
def _plane() -> np.ndarray:
    """Codes of the first 65,536 code points; surrogates stand for themselves."""
    return np.array([_codes.__missing__(point) for point in range(1 << 16)], dtype=np.int16)


def encode(text: str) -> np.ndarray:
    """One code for each code point."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if text.isascii() or not len(points) or points.max() < 1 << 16:
        return _plane()[points]
    out = _plane()[np.minimum(points, (1 << 16) - 1)]
    for k in np.flatnonzero(points >= 1 << 16):
        out[k] = _codes[int(points[k])]
    return out


def _field(number: int, value: int | str | bytes) -> bytes:
    """A field of a protocol buffer; numbers up to 127, texts under 16,384 bytes."""
    if isinstance(value, int):
        return bytes([number << 3, value])
    value = value.encode() if isinstance(value, str) else value
    size = bytes([len(value)]) if len(value) < 128 else bytes([len(value) & 127 | 128, len(value) >> 7])
    return bytes([number << 3 | 2]) + size + value


#: A step of the LSTM and its part of the tag scores, features in rows: operator, inputs, outputs.
_STEP = (
    ("MatMul", ("weights", "held"), ("z",)),
    ("Split", ("z",), ("zi", "zf", "zo", "zg")),
    ("Sigmoid", ("zi",), ("i",)),
    ("Sigmoid", ("zf",), ("f",)),
    ("Sigmoid", ("zo",), ("o",)),
    ("Tanh", ("zg",), ("g",)),
    ("Mul", ("f", "c"), ("kept",)),
    ("Mul", ("i", "g"), ("added",)),
    ("Add", ("kept", "added"), ("new_c",)),
    ("Tanh", ("new_c",), ("squashed",)),
    ("Mul", ("o", "squashed"), ("h",)),
    ("MatMul", ("last", "h"), ("score",)),
)


@lru_cache(maxsize=1)
def _runtime() -> tuple | None:
    """onnxruntime with _STEP as a session, whose tanh takes an eighth of the time of numpy's; None where it isn't installed."""
    try:
        import onnxruntime
    except ImportError:
        return None
    matrix = lambda name: _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, _field(1, _field(2, "m" + name)) + _field(1, _field(2, "n" + name)))))
    nodes = [b"".join(_field(1, x) for x in inputs) + b"".join(_field(2, x) for x in outputs) + _field(4, name) for name, inputs, outputs in _STEP]
    parts = [*(_field(1, n) for n in nodes), _field(2, "step"), *(_field(11, matrix(x)) for x in ("weights", "held", "c", "last")), *(_field(12, matrix(x)) for x in ("new_c", "h", "score"))]
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    model = _field(1, 8) + _field(7, b"".join(parts)) + _field(8, _field(2, 13))
    return onnxruntime, onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


def _step(weights: np.ndarray, held: np.ndarray, c: np.ndarray, last: np.ndarray, score: np.ndarray) -> Callable[[], object]:
    """Makes one step whenever it is called: puts the new cell into c, the new h into the first rows of held and its tag scores into score. All are contiguous."""
    h = held[: len(c)]
    runtime = _runtime() if c.dtype == np.float32 and c.size else None
    if runtime is not None:
        library, session = runtime
        binding = session.io_binding()  # shares the memory
        for name, x in (("weights", weights), ("held", held), ("c", c), ("last", last)):
            binding.bind_ortvalue_input(name, library.OrtValue.ortvalue_from_numpy(x))
        for name, x in (("new_c", c), ("h", h), ("score", score)):
            binding.bind_ortvalue_output(name, library.OrtValue.ortvalue_from_numpy(x))
        return lambda kept=(weights, held, c, last, score): session.run_with_iobinding(binding)
    z = np.empty((4 * len(c), c.shape[1]), dtype=c.dtype)
    gates, (i, f, o, g) = z[: 3 * len(c)], z.reshape(4, *c.shape)
    one = np.empty_like(c)

    def step() -> None:
        np.matmul(weights, held, out=z)
        np.negative(gates, out=gates)
        with np.errstate(over="ignore"):
            np.exp(gates, out=gates)
        np.add(gates, 1, out=gates)
        np.reciprocal(gates, out=gates)
        np.tanh(g, out=g)
        np.multiply(c, f, out=c)
        np.multiply(i, g, out=i)
        np.add(c, i, out=c)
        np.tanh(c, out=one)
        np.multiply(o, one, out=h)
        np.matmul(last, h, out=score)

    return step


def _sigmoid_tanh(z: np.ndarray, hidden: int) -> np.ndarray:
    """Gates i, f, o by the logistic function and g by tanh, in place."""
    z[..., : 3 * hidden] *= 0.5
    np.tanh(z, out=z)
    z[..., : 3 * hidden] *= 0.5
    z[..., : 3 * hidden] += 0.5
    return z


class Tagger:
    """Parameters and passes. Inputs are time-major: codes (T, B) and a mask of real characters."""

    def __init__(self, size: int = 20, hidden: int = 32, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        self.hidden = hidden
        self.p = {
            "symbol": draw(SYMBOLS, size, scale=0.3),
            "case": draw(2, size, scale=0.3),
            "wx": draw(2, size, 4 * hidden, scale=size**-0.5),
            "wh": draw(2, hidden, 4 * hidden, scale=hidden**-0.5),
            "b": np.zeros((2, 1, 4 * hidden), dtype=np.float32),
            "out": draw(2 * hidden, TAGS, scale=(2 * hidden) ** -0.5),
            "ob": np.zeros(TAGS, dtype=np.float32),
            "trans": draw(TAGS, TAGS, scale=0.1),
            "first": np.zeros(TAGS, dtype=np.float32),
        }
        self.p["b"][:, :, hidden : 2 * hidden] = 1.0

    @staticmethod
    def load(path: str) -> Tagger:
        with np.load(path) as held:
            out = Tagger(held["symbol"].shape[1], held["wh"].shape[1])
            out.p = {k: held[k].astype(np.float32) for k in held.files}
        return out

    def save(self, path: str) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    def _run(self, codes: np.ndarray, mask: np.ndarray, keep: bool) -> tuple:
        p, h_size = self.p, self.hidden
        steps, batch = codes.shape
        x = p["symbol"][codes % SYMBOLS] + p["case"][codes // SYMBOLS]
        both = np.stack([x, x[::-1]])
        live = np.stack([mask, mask[::-1]])[..., None].astype(np.float32)
        zx = np.matmul(both.reshape(2, steps * batch, -1), p["wx"]).reshape(2, steps, batch, -1) + p["b"][:, :, None, :]
        h = np.zeros((2, batch, h_size), dtype=np.float32)
        c = np.zeros_like(h)
        hs = np.empty((2, steps, batch, h_size), dtype=np.float32)
        kept = (np.empty_like(zx), np.empty_like(hs), np.empty_like(hs)) if keep else None
        for t in range(steps):
            z = _sigmoid_tanh(zx[:, t] + np.matmul(h, p["wh"]), h_size)
            c_new = z[..., h_size : 2 * h_size] * c + z[..., :h_size] * z[..., 3 * h_size :]
            c_new *= live[:, t]
            if keep:
                kept[0][:, t], kept[1][:, t] = z, c
            tc = np.tanh(c_new)
            if keep:
                kept[2][:, t] = tc
            h = z[..., 2 * h_size : 3 * h_size] * tc
            h *= live[:, t]
            c = c_new
            hs[:, t] = h
        top = np.concatenate([hs[0], hs[1, ::-1]], axis=-1)
        return top @ p["out"] + p["ob"], top, both, hs, live, kept

    def emissions(self, codes: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Tag scores (T, B, TAGS), the bias alone behind the end of a text. Features lie in rows, so that each gate is a whole array and a step is one product."""
        p, h_size = self.p, self.hidden
        steps, batch = codes.shape
        each = (p["symbol"][None] + p["case"][:, None]).reshape(2 * SYMBOLS, -1)
        kind = each.dtype
        lengths = mask.sum(axis=0)
        order = np.argsort(lengths, kind="stable")
        codes = codes[:, order].astype(np.intp)
        begins = np.searchsorted(lengths[order], np.arange(steps), side="right").tolist()  # the first text that is longer
        weights = np.ascontiguousarray(np.concatenate([p["wh"], p["wx"], p["b"]], axis=1).transpose(0, 2, 1))
        last = np.ascontiguousarray(p["out"].reshape(2, h_size, TAGS).transpose(0, 2, 1))
        out = np.zeros((steps, TAGS, batch), dtype=kind)
        for d, places in enumerate((range(steps), range(steps - 1, -1, -1))):
            # a step starts from h, the symbols and one for the bias
            held = np.ones((weights.shape[2], batch), dtype=kind)
            c, score = np.zeros((h_size, batch), dtype=kind), np.empty((TAGS, batch), dtype=kind)
            step = _step(weights[d], held, c, last[d], score)
            held[:h_size] = 0
            begin = batch
            for t in places:
                at = begins[t]
                if at < begin:  # texts that begin here start from nothing, whatever lies behind their end
                    held[:h_size, at:begin] = 0
                    c[:, at:begin] = 0
                begin = at
                if at < batch:
                    held[h_size:-1] = each.take(codes[t], axis=0).T
                    step()
                    out[t, :, at:] += score[:, at:]
        out += p["ob"][:, None]
        if (order[1:] < order[:-1]).any():
            out = out[:, :, np.argsort(order)]
        return out.transpose(0, 2, 1)

    def allowed(self) -> np.ndarray:
        """Transitions with those barred that no tagged text has: inside goes on only from begin or inside of its kind, and an item doesn't begin right behind another."""
        trans = np.full((TAGS, TAGS), -1e4, dtype=self.p["trans"].dtype)
        kept = np.zeros((TAGS, TAGS), dtype=bool)
        kept[:, 0] = True
        kept[0, 1::2] = True
        for k in range(1, TAGS, 2):
            kept[[k, k + 1], k + 1] = True
        trans[kept] = self.p["trans"][kept]
        return trans

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best tags (T, B) under the allowed transitions."""
        steps, batch, _ = scores.shape
        trans = self.allowed()
        first = self.p["first"].copy()
        first[2::2] = -1e4
        scores = np.ascontiguousarray(scores.transpose(0, 2, 1))
        best = np.empty((steps, TAGS, batch), dtype=scores.dtype)  # of the paths that end in a tag
        best[0] = scores[0] + first[:, None]
        stays = np.zeros((steps, batch), dtype=bool)  # whether the best path to O comes from O
        kinds = (TAGS - 1) // 2
        one, most = np.empty((kinds, batch), dtype=scores.dtype), np.empty((kinds, batch), dtype=scores.dtype)
        every = np.empty((TAGS, batch), dtype=scores.dtype)
        to_begin = np.ascontiguousarray(trans[0, 1::2])[:, None]
        to_none = np.ascontiguousarray(trans[:, 0])[:, None]
        from_begin, from_inside = (np.array([trans[k + d, k + 1] for k in range(1, TAGS, 2)])[:, None] for d in (0, 1))
        for t in range(1, steps):
            old, new = best[t - 1], best[t]
            np.add(old, to_none, out=every)
            every.max(axis=0, out=new[0])
            np.equal(every[0], new[0], out=stays[t])
            np.add(old[0], to_begin, out=new[1::2])
            np.add(old[1::2], from_begin, out=one)
            np.add(old[2::2], from_inside, out=most)
            np.maximum(one, most, out=new[2::2])
            new += scores[t]
        tags = np.zeros((steps, batch), dtype=np.int8)
        now = np.zeros(batch, dtype=np.int64)
        for t in range(steps - 1, -1, -1):
            last = lengths == t + 1
            asked = np.flatnonzero((lengths > t + 1) & ((now > 0) | ~stays[t + 1]) | last) if t + 1 < steps else np.flatnonzero(last)
            if len(asked):
                before = best[t][:, asked]
                before += np.where(last[asked], 0, trans[:, now[asked]])
                now[asked] = before.argmax(axis=0)
            tags[t] = now
        return tags

    def loss(self, codes: np.ndarray, mask: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log likelihood per character, and its gradients."""
        p, hid = self.p, self.hidden
        steps, batch = codes.shape
        e, top, both, hs, live, (zs, cs, tcs) = self._run(codes, mask, keep=True)
        rows = np.arange(batch)
        m = mask.astype(np.float32)
        soft = lambda x, axis: np.squeeze(x.max(axis, keepdims=True), axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
        alpha = np.empty_like(e)
        alpha[0] = e[0] + p["first"]
        for t in range(1, steps):
            new = soft(alpha[t - 1][:, :, None] + p["trans"], 1) + e[t]
            alpha[t] = np.where(mask[t][:, None], new, alpha[t - 1])
        total = soft(alpha[-1], 1)
        gold = e[0][rows, tags[0]] + p["first"][tags[0]]
        for t in range(1, steps):
            gold = gold + m[t] * (e[t][rows, tags[t]] + p["trans"][tags[t - 1], tags[t]])
        count = m.sum()
        g = {k: np.zeros_like(v) for k, v in p.items()}
        beta = np.zeros((batch, TAGS), dtype=np.float32)
        de = np.zeros_like(e)
        for t in range(steps - 1, -1, -1):
            de[t] = np.exp(alpha[t] + beta - total[:, None]) * m[t][:, None]
            if t:
                inner = e[t] + beta
                pair = np.exp(alpha[t - 1][:, :, None] + p["trans"] + (inner - total[:, None])[:, None, :]) * m[t][:, None, None]
                g["trans"] += pair.sum(0)
                np.subtract.at(g["trans"], (tags[t - 1], tags[t]), m[t])
                beta = np.where(mask[t][:, None], soft(p["trans"] + inner[:, None, :], 2), beta)
            de[t][rows, tags[t]] -= m[t]
        g["first"] = de[0].sum(0)
        de /= count
        g["trans"] /= count
        g["first"] /= count
        g["out"] = top.reshape(-1, 2 * hid).T @ de.reshape(-1, TAGS)
        g["ob"] = de.sum((0, 1))
        dtop = de @ p["out"].T
        dh_all = np.stack([dtop[..., :hid], dtop[::-1, :, hid:]])
        dh = np.zeros((2, batch, hid), dtype=np.float32)
        dc = np.zeros_like(dh)
        dz = np.empty_like(zs)
        wht = p["wh"].transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            z, lv = zs[:, t], live[:, t]
            i, f, o, gg = z[..., :hid], z[..., hid : 2 * hid], z[..., 2 * hid : 3 * hid], z[..., 3 * hid :]
            d = (dh + dh_all[:, t]) * lv
            dcc = (dc + d * o * (1 - tcs[:, t] ** 2)) * lv
            out = dz[:, t]
            out[..., :hid] = dcc * gg * i * (1 - i)
            out[..., hid : 2 * hid] = dcc * cs[:, t] * f * (1 - f)
            out[..., 2 * hid : 3 * hid] = d * tcs[:, t] * o * (1 - o)
            out[..., 3 * hid :] = dcc * i * (1 - gg**2)
            dh = np.matmul(out, wht)
            dc = dcc * f
        before = np.concatenate([np.zeros((2, 1, batch, hid), dtype=np.float32), hs[:, :-1]], axis=1)
        flat = dz.reshape(2, steps * batch, -1)
        g["wh"] = np.matmul(before.reshape(2, steps * batch, hid).transpose(0, 2, 1), flat)
        g["wx"] = np.matmul(both.reshape(2, steps * batch, -1).transpose(0, 2, 1), flat)
        g["b"] = flat.sum(1, keepdims=True)
        dx = np.matmul(flat, p["wx"].transpose(0, 2, 1)).reshape(2, steps, batch, -1)
        dx = dx[0] + dx[1, ::-1]
        np.add.at(g["symbol"], codes % SYMBOLS, dx)
        np.add.at(g["case"], codes // SYMBOLS, dx)
        return float((total - gold).sum() / count), g
