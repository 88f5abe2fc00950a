"""Plain models of the order-dependent operators, written for the tests only."""

from __future__ import annotations


def runs(hashes: list[int], radius: int) -> list[int]:
    out: list[int] = []
    rep, number = None, -1
    for h in hashes:
        if rep is None or bin((rep ^ h) & (2**64 - 1)).count("1") > radius:
            rep, number = h, number + 1
        out.append(number)
    return out


def even_parts(n: int, target: int) -> list[int]:
    if n <= target:
        return list(range(n))
    parts = [0] * n
    for b in range(target):
        for i in range(b * n // target, (b + 1) * n // target):
            parts[i] = b
    return parts


def longest_run(numbers: set[int]) -> int:
    best = 0
    for n in numbers:
        if n - 1 not in numbers:
            length = 1
            while n + length in numbers:
                length += 1
            best = max(best, length)
    return best


def scene_times(start: float, end: float) -> list[float]:
    span = max(end - start, 0.0)
    times = [start]
    if span > 2.5:
        n = min(int(span // 2.5), max(10, int(span // 20) + 1) - 1)
        step = span / (n + 1)
        times += [start + step * k for k in range(1, n + 1) if start + step * k < end - 0.5]
    return times


def nearest(t: float, frames: list[tuple[int, float]]) -> int | None:
    if not frames:
        return None
    return min(frames, key=lambda f: (abs(f[1] - t), f[0]))[0]
