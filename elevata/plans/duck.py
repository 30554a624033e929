"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations


def inter(a: str, b: str) -> str:
    side = lambda p, s: f"greatest(least({a}.{p} + {a}.{s}, {b}.{p} + {b}.{s}) - greatest({a}.{p}, {b}.{p}), 0)"
    return f"({side('x', 'w')} * {side('y', 'h')})"


def iou(a: str, b: str) -> str:
    both = inter(a, b)
    return f"(CASE WHEN {a}.w * {a}.h + {b}.w * {b}.h - {both} > 0 THEN {both}::DOUBLE / ({a}.w * {a}.h + {b}.w * {b}.h - {both}) ELSE 0.0::DOUBLE END)"


def apart(a: str, b: str) -> str:
    """Distance of two boxes' centres."""
    d = lambda p, s: f"(({a}.{p} + {a}.{s} * 0.5::DOUBLE) - ({b}.{p} + {b}.{s} * 0.5::DOUBLE))"
    return f"sqrt({d('x', 'w')} * {d('x', 'w')} + {d('y', 'h')} * {d('y', 'h')})"


def greedy(pairs: str, group: str, left: str, right: str, order: str) -> str:
    """CTEs that end in ``chosen``(group, left, right): one-to-one pairs of
    ``pairs`` in ``order``, by recursion along each group."""
    return f"""
      seq AS (SELECT {group} AS g, {left} AS l, {right} AS r, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM {pairs}),
      walk AS (SELECT g, k, [l] AS ls, [r] AS rs FROM seq WHERE k = 1
        UNION ALL SELECT seq.g, seq.k, CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN ls ELSE list_append(ls, l) END,
                         CASE WHEN list_contains(ls, l) OR list_contains(rs, r) THEN rs ELSE list_append(rs, r) END
        FROM walk JOIN seq ON seq.g = walk.g AND seq.k = walk.k + 1),
      ended AS (SELECT g, arg_max(ls, k) AS ls, arg_max(rs, k) AS rs FROM walk GROUP BY g),
      chosen AS (SELECT g AS {group}, unnest(ls) AS {left}, unnest(rs) AS {right} FROM ended)"""
