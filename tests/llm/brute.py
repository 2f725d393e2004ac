"""Plain versions of the operators over small lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def ascii_lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def benchmark_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text or ""))


def contamination(docs, benchmark):
    """(doc_id, n_words, n_hit, item ids, contaminated) per document."""
    windows: dict[tuple, set] = {}
    for item, text in benchmark:
        words = benchmark_words(text)
        n = min(13, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, items = benchmark_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if found := windows.get(tuple(words[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out.append(
            (doc, len(words), len(hit), sorted(items), bool(hit) and 20 * len(hit) >= len(words))
        )
    return out


_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def secret_base(text: str | None) -> list[tuple[int, int, str]]:
    """Base findings (start, end, kind) by start, then kind."""
    text, found = text or "", []
    for rank, (kind, pattern, group, least) in enumerate(
        [
            ("assign", _ASSIGN, 1, 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
            ("hex", re.compile("[0-9a-f]+"), 0, 24),
        ]
    ):
        found += [
            (m.start(), rank, m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least
        ]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def quality_base(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    words = word.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if word.search(line):
            dup += line in seen
            seen.add(line)
    places: dict[tuple, list[int]] = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def shingle_set(text: str | None, width: int = 5) -> set[tuple]:
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    if not words:
        return set()
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def components(docs, percent: int = 80):
    """(doc_id, set size, smallest linked doc_id) per document."""
    sets = [(d, shingle_set(t)) for d, t in docs]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by_shingle: dict[tuple, list[int]] = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(k)
    pairs = {(a, b) for ks in by_shingle.values() for i, a in enumerate(ks) for b in ks[i + 1 :]}
    for a, b in pairs:
        (da, sa), (db, sb) = sets[a], sets[b]
        if 100 * len(sa & sb) >= percent * len(sa | sb):
            x, y = sorted((find(da), find(db)))
            root[y] = x
    return [(d, len(s), find(d)) for d, s in sets]


def ranked(docs, items, k: int = 50):
    """(item_id, rank, doc_id, score) of the k best documents of every item."""
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counted = [(d, Counter(term.findall(ascii_lower(text or "")))) for d, text in docs]
    n_docs = sum(bool(c) for _, c in counted)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item, text in items:
        wanted = set(term.findall(ascii_lower(text or "")))
        scores = []
        for doc, c in counted:
            score = 0
            for t in wanted & c.keys():
                m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
                score += weight[t] * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc))
        for rank, (score, _, doc) in enumerate(sorted(scores)[:k], 1):
            out.append((item, rank, doc, -score))
    return out


def damage(rows):
    """(conv, turn, role, text) rows after the damage of the structure repair query."""
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        out += [] if kind == 0 else [(conv, turn, role, text)] * (1 + (kind == 3))
    return out


def repair(rows):
    """Faults and cheapest repair of one conversation's rows (turn, role, text) in order."""
    counts, seen, todo = {"b": 0, "d": 0, "t": 0}, set(), []
    for _, role, text in rows:
        ends = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = (
            "b" if not ends else "d" if (role, text) in seen else "t" if ends[-1] not in ".!?" else ""
        )
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        todo.append((role, text, fault))
    inits = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(inits, inits[1:]))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0

    def legal(state, role):
        return {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("2", "a"): "0a", ("0a", "u"): "2"}.get(
            (state, role)
        )

    def better(best, state, cost, audit, done):
        if state is not None and (state not in best or (cost, audit) < best[state][:2]):
            best[state] = (cost, audit, done)

    def inserted(best):
        for _ in range(6):
            for state, (cost, audit, done) in list(best.items()):
                for role in ("user", "assistant"):
                    better(best, legal(state, role[0]), cost + 3, audit + "I", [*done, (role, "")])
        return best

    best = inserted({"0": (0, "", [])})
    for role, text, fault in todo:
        after = {}
        for state, (cost, audit, done) in best.items():
            better(after, state, cost + 4, audit + "D", done)
            if fault in ("b", "d"):
                continue
            more = 3 if fault == "t" else 0
            better(after, legal(state, role[:1]), cost + more, audit + "K", [*done, (role, text)])
            for new in ("user", "assistant"):
                better(after, legal(state, new[0]), cost + more + 3, audit + "R", [*done, (new, text)])
        best = inserted(after)
    cost, audit, done = min(best[s] for s in ("0", "0a") if s in best)
    digest = sha("\n".join(f"{r}:{t}" for r, t in done))
    return gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest, done
