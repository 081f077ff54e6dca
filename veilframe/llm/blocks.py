"""Main text of web pages: a bidirectional LSTM labels the sequence of leaf blocks of a page."""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of hashed tag-path steps and words, sizes of their vectors, and of each direction's state.
PATHS, WORDS, PATH_DIM, WORD_DIM, STATE, EXTRA = 256, 256, 12, 6, 12, 4
#: Pages the fit reads at most, and the longest page it takes, each with all its blocks.
SAMPLE, SAMPLE_CHARS = 160, 200_000
EPOCHS = 12

#: Comments, elements whose content is no markup, tags (with balanced quotes or, failing that, up to the next ``>``), declarations.
#: Nothing here tries a place twice, so the time is linear in the page.
MARKUP = re.compile(
    r"<!--.*?(?P<shut>-->|\Z)|<(script|style|iframe|textarea)\b[^>]*+>.*?(?P<closed></\2\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<names>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|<[!?][^>]*+>", re.S | re.I)
CUT_OFF = re.compile(r"<[a-z/!?]", re.I)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span "
                   "strike strong sub sup time tt u var wbr".split())
#: Elements that are markup inside but show no text of the article.
HIDDEN = frozenset("button noscript select svg template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table td ul".split())
BLOCK_ENDS_P = frozenset("article aside blockquote div dl footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section "
                         "table ul".split())

#: What teaches the labeller: names of parts that are main text, and of parts that never are.
MAIN = frozenset("article main content entry post story body-text articlebody".split())
REST = frozenset(
    "nav footer aside form head title header menu sidebar ad ads advert advertisement sponsor sponsored promo banner notice "
    "cookie cookies consent popup newsletter subscribe comments comment reply replies breadcrumb breadcrumbs share "
    "social related pagination widget toolbar login search".split())


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: float


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, white space folded and references decoded; empty ones are left out.

    Text in hidden elements is left out; one that is not closed ends with its parent, and ``<svg/>`` is
    empty. A comment or script that is not closed runs to the end of the page, and a tag that the end of
    the page cuts off is no text.
    """
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    hidden: list[int] = []  # places of hidden elements in the stack
    opened: dict[str, int] = {}  # how often each tag is in the stack
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal parts, linked
        raw = "".join(parts)
        text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
        if text:
            shown = stack[:hidden[0]] if hidden else stack
            path = tuple(step for tag, names in shown if tag not in INLINE for step in (tag, *names))
            out.append(Block(path, text, min(1.0, linked / max(1, len(raw)))))
        parts, linked = [], 0

    def push(tag: str, names: tuple[str, ...]) -> None:
        stack.append((tag, names))
        opened[tag] = opened.get(tag, 0) + 1

    def pop(tags, stop=frozenset()) -> None:
        if not any(opened.get(tag) for tag in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                if hidden and k < hidden[0] and stack[k][0] not in INLINE:
                    flush()
                for tag, _ in stack[k:]:
                    opened[tag] -= 1
                del stack[k:]
                while hidden and hidden[-1] >= k:
                    hidden.pop()
                return
            if stack[k][0] in stop:
                return

    def take(piece: str) -> None:
        nonlocal linked
        if piece and not hidden:
            parts.append(piece)
            if any(tag == "a" for tag, _ in stack[-4:]):
                linked += len(piece)

    for m in MARKUP.finditer(page, 0, page.rfind(">") + 1):  # no markup ends behind that
        take(page[at:m.start()])
        at = m.end()
        if m["shut"] == "" or m["closed"] == "":
            at = len(page)
            break
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in HIDDEN:
            if m["end"]:
                pop((tag,))
            elif not (tag == "svg" and m["names"].rstrip().endswith("/")):
                hidden.append(len(stack))
                push(tag, ())
            continue
        if hidden:
            if m["end"]:
                pop((tag,))
            elif tag not in VOID and not m["names"].rstrip().endswith("/"):
                push(tag, ())
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            elif tag not in VOID:
                if m["end"]:
                    pop((tag,), SCOPE)
                else:
                    push(tag, ())
            continue
        flush()
        if m["end"]:
            pop((tag,))
            continue
        if tag in BLOCK_ENDS_P:
            pop(("p",), SCOPE)
        if tag in CLOSED_BY:
            pop(CLOSED_BY[tag], SCOPE)
        if tag not in VOID:
            names = tuple(w.lower() for g in NAMES.findall(m["names"]) for w in re.split(r"[\s_]+", "".join(g)) if w)
            push(tag, names)
    tail = page[at:]
    cut = CUT_OFF.search(tail)
    take(tail[:cut.start()] if cut else tail)
    flush()
    return out


def _steps(path: tuple[str, ...]) -> list[str]:
    """What of a path is hashed: each step, with and without its place from the root, and its hyphenated parts."""
    out = []
    for step in path:
        out.append(step)
        if "-" in step:
            out += step.split("-")
    return out + ["/".join(path[-2:])]


def teach(path: tuple[str, ...]) -> float:
    """1 for main text, 0 for the rest, -1 where a path does not tell."""
    steps = {s for step in path for s in (step, *step.split("-"))}
    if steps & REST:
        return 0.0
    return 1.0 if steps & MAIN else -1.0


def _bucket(word: str, size: int) -> int:
    return zlib.crc32(word.encode()) % size


def inputs(blocks: list[Block], seen: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Path counts, word counts and plain measures of each block. ``seen`` remembers paths and words."""
    n = len(blocks)
    paths, words = np.zeros((n, PATHS), np.float32), np.zeros((n, WORDS), np.float32)
    extra = np.zeros((n, EXTRA), np.float32)
    for k, block in enumerate(blocks):
        buckets = seen.get(block.path)
        if buckets is None:
            buckets = seen[block.path] = np.array([_bucket(s, PATHS) for s in _steps(block.path)])
        np.add.at(paths[k], buckets, 1.0 / len(buckets))
        tokens = block.text.split(" ")
        found = np.fromiter((zlib.crc32(t.encode()) for t in tokens), np.int64, len(tokens)) % WORDS
        words[k] = np.bincount(found, minlength=WORDS) / len(tokens)
        extra[k] = (np.log1p(len(tokens)) / 5, block.linked, block.text.count(".") / len(tokens), 1.0)
    return paths, words, extra


class Labeller:
    """Two LSTMs over the blocks of a page; the output sees both states and the block's own vector."""

    taught = True  # whether some page told what main text is

    def __init__(self, seed: int = 11):
        r, d = np.random.default_rng(seed), PATH_DIM + WORD_DIM + EXTRA
        s = lambda *shape: (r.standard_normal(shape) * 0.3 / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
        self.p = {"P": s(PATHS, PATH_DIM) * 4, "W": s(WORDS, WORD_DIM) * 4, "out": s(2 * STATE + d, 1)[:, 0], "c": np.zeros(1, np.float32)}
        for way in "fb":
            self.p |= {f"X{way}": s(d, 4 * STATE), f"H{way}": s(STATE, 4 * STATE), f"B{way}": np.zeros(4 * STATE, np.float32)}
            self.p[f"B{way}"][STATE:2 * STATE] = 1.0  # remember at first

    def vectors(self, paths, words, extra) -> np.ndarray:
        return np.concatenate((paths @ self.p["P"], words @ self.p["W"], extra), axis=-1)

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States of one direction for ``x`` (pages, blocks, inputs); masked steps leave the state alone."""
        n, length, _ = x.shape
        h, c = np.zeros((n, STATE), np.float32), np.zeros((n, STATE), np.float32)
        out = np.zeros((n, length, STATE), np.float32)
        fed = x @ self.p[f"X{way}"] + self.p[f"B{way}"]
        for t in (range(length) if way == "f" else range(length - 1, -1, -1)):
            a = fed[:, t] + h @ self.p[f"H{way}"]
            gates = 1 / (1 + np.exp(-a[:, :3 * STATE]))
            i, f, o = gates[:, :STATE], gates[:, STATE:2 * STATE], gates[:, 2 * STATE:]
            g = np.tanh(a[:, 3 * STATE:])
            m = mask[:, t:t + 1]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c = m * c_new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        z = np.concatenate((self._run(x, mask, "f", None), self._run(x, mask, "b", None), x), axis=-1)
        return z @ self.p["out"] + self.p["c"]

    def gradients(self, paths, words, extra, y, mask) -> tuple[float, dict]:
        """Mean log loss over taught blocks and its gradients, through both directions.

        A page weighs by the square root of its taught blocks, so that a long one does not outvote all others.
        """
        x = self.vectors(paths, words, extra)
        kept = {"f": [], "b": []}
        states = [self._run(x, mask, way, kept[way]) for way in "fb"]
        z = np.concatenate((*states, x), axis=-1)
        p = 1 / (1 + np.exp(-np.clip(z @ self.p["out"] + self.p["c"], -30, 30)))
        taught = ((y >= 0) & (mask > 0)).astype(np.float32)
        taught /= np.sqrt(np.maximum(1.0, taught.sum(axis=1, keepdims=True)))
        total = max(1.0, taught.sum())
        loss = float(-(taught * np.log(np.where(y > 0, p, 1 - p) + 1e-9)).sum() / total)
        d = ((p - y) * taught / total).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["out"], g["c"] = np.einsum("nt,ntk->k", d, z), np.array([d.sum()], np.float32)
        dz = d[..., None] * self.p["out"]
        dx = dz[..., 2 * STATE:].copy()
        for k, way in enumerate("fb"):
            dh_next = np.zeros((len(x), STATE), np.float32)
            dc_next = np.zeros((len(x), STATE), np.float32)
            for t, h, c, i, f, o, gg, tc, m in reversed(kept[way]):
                dh = dz[:, t, k * STATE:(k + 1) * STATE] + dh_next
                dhm = dh * m
                dc = dhm * o * (1 - tc * tc) + dc_next * m
                da = np.concatenate((dc * gg * i * (1 - i), dc * c * f * (1 - f), dhm * tc * o * (1 - o), dc * i * (1 - gg * gg)), axis=1)
                g[f"H{way}"] += h.T @ da
                g[f"B{way}"] += da.sum(axis=0)
                g[f"X{way}"] += x[:, t].T @ da
                dx[:, t] += da @ self.p[f"X{way}"].T
                dh_next = da @ self.p[f"H{way}"].T + dh * (1 - m)
                dc_next = dc * f + dc_next * (1 - m)
        flat = dx.reshape(-1, dx.shape[-1])
        g["P"] = paths.reshape(-1, PATHS).T @ flat[:, :PATH_DIM]
        g["W"] = words.reshape(-1, WORDS).T @ flat[:, PATH_DIM:PATH_DIM + WORD_DIM]
        return loss, g


def _padded(pages: list[tuple]) -> tuple[np.ndarray, ...]:
    longest = max(len(p[0]) for p in pages)
    out = [np.zeros((len(pages), longest, *p.shape[1:]), np.float32) for p in pages[0]]
    mask = np.zeros((len(pages), longest), np.float32)
    for k, page in enumerate(pages):
        mask[k, :len(page[0])] = 1
        for to, part in zip(out, page):
            to[k, :len(part)] = part
    return (*out, mask)


def _varied(blocks: list[Block], random: np.random.Generator, spare: list[str]) -> list[Block]:
    """The page with its parts renamed and with further parts set in, so that labels rest on more than one template."""
    rename = random.choice(["article", "article", "article", "main", "div.content", "div.post", "section.entry", "div.story"])
    out = []
    for b in blocks:
        path = tuple(x for s in b.path for x in (rename.split(".") if s == "article" else [s]))
        out.append(Block(path, b.text, b.linked))
    inside = [k for k, b in enumerate(out) if teach(b.path) == 1]
    for name in random.permutation(sorted(REST - {"head", "title"}))[:4]:
        own = str(name) if name in ("nav", "footer", "aside", "form", "header") else None
        inner = bool(inside) and random.random() < 0.4
        base = out[inside[0]].path[:-1] if inner else ("html", "body")
        path = (*base, *((own,) if own else ("div", str(name))), str(random.choice(["p", "li", "div", "p"])))
        at = (int(random.choice(inside)) if inner else int(random.integers(0, len(out) + 1)))
        new = [Block(path, spare[int(random.integers(len(spare)))], float(random.random() < 0.3)) for _ in range(int(random.integers(1, 4)))]
        out[at:at] = new
        inside = [k for k, b in enumerate(out) if teach(b.path) == 1]
    return out


def fit(pages: list[str], seed: int = 3) -> Labeller:
    """Train on pages whose paths tell some labels, each with varied copies of itself; without any, nothing is taught."""
    model, random = Labeller(), np.random.default_rng(seed)
    parsed = [b for b in map(leaf_blocks, pages) if b]
    spare = [b.text for page in parsed[:100] for b in page][:2000] or ["none"]
    seen: dict = {}
    data = []
    for page in parsed:
        for blocks in (page, _varied(page, random, spare), _varied(page, random, spare)):
            y = np.array([teach(b.path) for b in blocks], np.float32)
            if (y >= 0).any():
                data.append((*inputs(blocks, seen), y))
    model.taught = any(teach(b.path) == 1 for page in parsed for b in page)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step, data = 0, sorted(data, key=lambda d: len(d[0]))
    groups = [data[k:k + 32] for k in range(0, len(data), 32)]
    for epoch in range(EPOCHS):
        for k in random.permutation(len(groups)):
            step += 1
            _, g = model.gradients(*_padded(groups[k]))
            norm = max(1.0, np.sqrt(sum(float((v * v).sum()) for v in g.values())))
            for name, (m, v) in moments.items():
                grad = g[name] / norm
                m += 0.1 * (grad - m)
                v += 0.01 * (grad**2 - v)
                model.p[name] -= 0.03 * 0.75**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def fit_labeller(pages: DataFrame, sample: int = SAMPLE, text: str = "html", key: str = "page_id") -> Labeller:
    """Fit on at most ``sample`` pages of at most ``SAMPLE_CHARS`` characters, those whose ids hash lowest.

    The hashes are picked first, so that each task sends numbers, and only the chosen pages reach the driver.
    """
    known = pages.filter(F.col(text).isNotNull() & (F.char_length(text) <= SAMPLE_CHARS)).select(
        F.xxhash64(key).alias("h"), F.col(text).alias("html"))
    lowest = [r["h"] for r in known.select("h").orderBy("h").limit(sample).collect()]
    rows = known.filter(F.col("h") <= max(lowest)).orderBy("h", "html").limit(sample).collect() if lowest else []
    return fit([r[1] for r in rows])


def main_text(pages: DataFrame, model: Labeller, text: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, text, n_chars, blocks`` for every row; null and empty pages have an empty text.

    Where no page told the model what main text is, all blocks stay but those whose path names another part.
    No rows give no rows.
    Rows with null or repeated ids are read like any other. One narrow stage; a task holds one group of pages.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict = {}
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                found = [leaf_blocks(h or "") for h in batch.column(2).to_pylist()]
                texts: list[str] = [""] * len(found)
                if len(seen) > 100_000:
                    seen.clear()
                order = sorted((k for k in range(len(found)) if found[k]), key=lambda k: len(found[k]))
                start = 0
                while start < len(order):  # pages of like length share a run; its padded size is bounded
                    end = start + 1
                    while end < len(order) and end - start < 32 and (end - start + 1) * len(found[order[end]]) <= 2048:
                        end += 1
                    group = order[start:end]
                    vectors = [(model.vectors(*inputs(found[k], seen)),) for k in group]
                    x, mask = _padded(vectors)
                    scores = model.scores(x, mask)
                    for row, k in enumerate(group):
                        texts[k] = "\n".join(b.text for b, s in zip(found[k], scores[row]) if (
                            s > 0 if model.taught else teach(b.path) != 0))
                    start = end
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                       pa.array([len(t) for t in texts], pa.int64()),
                                       pa.array([len(f) for f in found], pa.int64())],
                                      ["page_id", "url", "text", "n_chars", "blocks"])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.col(text).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long, blocks long")
