"""Order and grouping of tables by their foreign keys. Driver-side; as large as the schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from .meta import ForeignKeyMeta, SchemaError, SchemaMeta, TableMeta

SIMPLE, SELF, DEFERRED, BACKFILL = "Simple", "SelfReferencing", "Deferred", "Backfill"


class UnsatisfiableCycle(SchemaError):
    pass


@dataclass
class Group:
    kind: str
    tables: list[str]
    broken: list[tuple[str, str]] = field(default_factory=list)  # (table, foreign key) that are filled in afterwards


def components(nodes: list[str], after: dict[str, set[str]]) -> list[list[str]]:
    """Strongly connected components, parents before children; ties in alphabetical order.

    Path-based, with an explicit stack. after[x]: nodes that refer to x.
    """
    before: dict[str, set[str]] = {n: set() for n in nodes}
    for x, ys in after.items():
        for y in ys:
            before[y].add(x)
    number: dict[str, int] = {}
    owner: dict[str, int] = {}
    found: list[list[str]] = []
    for root in sorted(nodes):
        if root in number:
            continue
        number[root] = len(number)
        work, path, ends = [(root, iter(sorted(before[root])))], [root], [root]
        while work:
            node, rest = work[-1]
            step = next(rest, None)
            if step is None:
                work.pop()
                if ends[-1] == node:
                    ends.pop()
                    own = []
                    while True:
                        own.append(path.pop())
                        owner[own[-1]] = len(found)
                        if own[-1] == node:
                            break
                    found.append(sorted(own))
            elif step not in number:
                number[step] = len(number)
                work.append((step, iter(sorted(before[step]))))
                path.append(step)
                ends.append(step)
            elif step not in owner:
                while number[ends[-1]] > number[step]:
                    ends.pop()
    needs = [{owner[p] for n in group for p in before[n]} - {i} for i, group in enumerate(found)]
    out: list[list[str]] = []
    placed: set[int] = set()
    while len(placed) < len(found):
        ready = min((i for i in range(len(found)) if i not in placed and needs[i] <= placed), key=lambda i: found[i])
        placed.add(ready)
        out.append(found[ready])
    return out


def toposort(nodes: list[str], edges: list[tuple[str, str]]) -> list[str] | None:
    """(parent, child) edges; None if there is a cycle."""
    left, out = set(nodes), []
    while left:
        held = {c for p, c in edges if p in left and c in left}
        ready = sorted(left - held)
        if not ready:
            return None
        out.append(ready[0])
        left.remove(ready[0])
    return out


def _all_nullable(t: TableMeta, fk: ForeignKeyMeta) -> bool:
    return all(t.column(c).nullable for c in fk.columns)


def _sequence_loop(t: TableMeta, fk: ForeignKeyMeta) -> bool:
    """A reference to the own table's sequence-backed key: rows can point to earlier rows."""
    return all(t.has(c) and t.column(c).sequence_backed for c in fk.ref_columns)


def plan_insertion(schema: SchemaMeta) -> list[Group]:
    """Groups of tables, parents first, each with the way in which its cycle (if any) is resolved."""
    names = [t.qualified for t in schema.tables]
    after: dict[str, set[str]] = {n: set() for n in names}
    for child, _, parent in schema.edges():
        after[parent.qualified].add(child.qualified)
    out = []
    for own in components(names, after):
        inner = [(c, fk, p) for c, fk, p in schema.edges() if c.qualified in own and p.qualified in own]
        loops = [(c, fk) for c, fk, p in inner if c is p and _sequence_loop(c, fk)]
        if not inner:
            out.append(Group(SIMPLE, own))
        elif len(own) == 1 and len(loops) == len(inner):
            out.append(Group(SELF, own))
        elif any(fk.deferrable for _, fk, _ in inner):
            out.append(Group(DEFERRED, own))
        else:
            skip = {(c.qualified, fk.name) for c, fk in loops}
            rest = [(c, fk, p) for c, fk, p in inner if (c.qualified, fk.name) not in skip]
            broken = sorted((c.qualified, fk.name) for c, fk, p in rest if _all_nullable(c, fk))
            hard = [(p.qualified, c.qualified) for c, fk, p in rest if not _all_nullable(c, fk)]
            if not broken or toposort(own, hard) is None:
                said = ", ".join(sorted(f"{c.qualified}.{fk.name}" for c, fk, p in rest if not _all_nullable(c, fk)))
                raise UnsatisfiableCycle(f"tables {', '.join(own)} refer to each other in a cycle that no nullable or deferrable foreign key opens: {said}")
            out.append(Group(BACKFILL, own, broken))
    return out


def deferred_write_order(schema: SchemaMeta, tables: list[str]) -> list[str]:
    """Order of a deferred group's tables: edges that can't be deferred must run parent to child, nullable ones may be opened."""
    inner = [(c, fk, p) for c, fk, p in schema.edges() if c.qualified in tables and p.qualified in tables and c is not p and not fk.deferrable]
    order = toposort(tables, [(p.qualified, c.qualified) for c, fk, p in inner])
    if order is None:
        order = toposort(tables, [(p.qualified, c.qualified) for c, fk, p in inner if not _all_nullable(c, fk)])
    if order is None:
        raise SchemaError(f"no valid write order for {', '.join(sorted(tables))}: foreign keys that can be neither deferred nor null form a cycle")
    return order


def check_deferred(schema: SchemaMeta, tables: list[str], strict_parity: bool = False) -> None:
    """Under strict_parity, keys that a server would assign are refused in a deferred cycle; ours are known beforehand."""
    deferred_write_order(schema, tables)
    if not strict_parity:
        return
    for c, fk, p in schema.edges():
        if c.qualified in tables and p.qualified in tables and any(p.has(r) and p.column(r).server_assigned for r in fk.ref_columns):
            raise SchemaError(f"{c.qualified}.{fk.name} refers to a server-assigned key of {p.qualified} inside a deferred cycle")


@dataclass
class Node:
    table: str
    depth: int
    cyclic: bool = False


def dependency_tree(schema: SchemaMeta) -> list[Node]:
    """The graph as an indented forest, parents first. A table met again on its own path is marked and not opened; a component without a root is shown once."""
    below: dict[str, set[str]] = {t.qualified: set() for t in schema.tables}
    above: dict[str, set[str]] = {t.qualified: set() for t in schema.tables}
    for c, _, p in schema.edges():
        below[p.qualified].add(c.qualified)
        above[c.qualified].add(p.qualified)
    out: list[Node] = []
    seen: set[str] = set()

    def show(name: str, depth: int, path: tuple[str, ...]) -> None:
        out.append(Node(name, depth, name in path))
        seen.add(name)
        if name not in path:
            for x in sorted(below[name]):
                show(x, depth + 1, (*path, name))

    for name in sorted(below):
        if not above[name] - {name}:
            show(name, 0, ())
    for name in sorted(below):
        if name not in seen:
            show(name, 0, ())
    return out


def referenced(schema: SchemaMeta) -> set[str]:
    """Tables whose keys others sample from."""
    return {p.qualified for _, _, p in schema.edges()}
