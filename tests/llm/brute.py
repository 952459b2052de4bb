"""The contracts said plainly, over lists, for comparison with the operators."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

BLANK = r"[\x20\x09-\x0D]"


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def _digits(hit: str) -> str:
    return re.sub("[^0-9]", "", hit)


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda h: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda h: all(int(p) <= 255 for p in h.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda h: 16 <= len(_digits(h)) <= 19 and luhn(_digits(h))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda h: 8 <= len(_digits(h)) <= 15),
]
SECRETS = [
    (
        "assign",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|(?i:passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        lambda h: True,
    ),
    ("access", "AKIA[A-Z0-9]+", lambda h: len(h) >= 18),
    ("hex", "[0-9a-f]+", lambda h: len(h) >= 16),
]


def spans(text: str | None, kinds) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern, ok in kinds:
        for m in re.finditer(pattern, text or "", re.ASCII):
            if ok(m[0]) and (kind != "assign" or len(m[1]) >= 12):
                out.append((kind, m.start(), m.end()))
    return out


def digest(found: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in found).encode()).hexdigest()


def repeated_words(own: list[str]) -> int:
    windows = [tuple(own[i : i + 5]) for i in range(len(own) - 4)]
    seen = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)})


def base_quality(text: str | None) -> dict:
    own, text = words(text), text or ""
    lines = [x for x in text.split("\n") if words(x)]
    n, repeat = len(own), repeated_words(own)
    return {
        "n_words": n,
        "word_chars": sum(map(len, own)),
        "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat,
        "base_failed": n < 10 or 100 * repeat > 20 * n,
    }


def exact(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    """``(id, keep_id, group_size, sha)`` for each row."""
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(BLANK, "", text or "")].append((key, text or ""))
    out = []
    for content, own in groups.items():
        keep = min(own, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0))[0]
        out += [(key, keep, len(own), hashlib.sha256(content.encode()).hexdigest()) for key, _ in own]
    return out


def fingerprint(text: str | None, shingle: int = 3) -> int:
    own = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    joined = [" ".join(own[i : i + shingle]) for i in range(len(own) - shingle + 1)] or [" ".join(own)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in joined]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near(rows: list[tuple[int | None, str | None]], bits: int = 2) -> list[tuple]:
    """``(id, fingerprint, component_id)`` for each row."""
    fps = np.array([fingerprint(t) for _, t in rows], np.uint64)
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= bits):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    least: dict[int, int | None] = {}
    for i, (key, _) in enumerate(rows):
        r = root(i)
        own = [k for k in (least.get(r), key) if k is not None]
        least[r] = min(own) if own else None
    return [(key, f"{int(fps[i]):016x}", least[root(i)]) for i, (key, _) in enumerate(rows)]
