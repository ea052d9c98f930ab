"""The gate for user SQL: what Spark's parser and analyser make of a statement
decides, not its spelling."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from loometry import fixed

_LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Nodes that do something other than read, as interfaces of Spark's plans.
_STATEMENTS = (_LOGICAL + "Command", _LOGICAL + "ParsedStatement", _LOGICAL + "Statement")
#: Leaves that read nothing stored.
_CONSTANT_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "EmptyRelation", "UnionLoopRef"}


class Refused(ValueError):
    """The statement may not run; the message says why."""


@dataclass
class Gate:
    """Lets read-only statements over the given views of one session pass."""

    spark: SparkSession

    def parse(self, text: str) -> JavaObject:
        """The parsed plan of one query; nothing has run and no name is resolved."""
        body = (text or "").strip().rstrip(";").strip()
        if not body:
            raise Refused(fixed.NOT_A_QUERY)
        parser = self.spark._jsparkSession.sessionState().sqlParser()
        try:
            plan = parser.parsePlan(body)
        except (ParseException, Py4JJavaError) as error:
            raise Refused(fixed.NOT_ONE_STATEMENT if ";" in body else str(error)) from error
        for node in _nodes(plan):
            if any(self._is(node, kind) for kind in _STATEMENTS):
                raise Refused(fixed.NOT_A_QUERY)
            # Names made up at run time would be seen by nobody before they resolve.
            if "UnresolvedIdentifier" in node.getClass().getSimpleName():
                raise Refused(fixed.FORBIDDEN)
            for part in _expressions(node):
                kind = part.getClass().getSimpleName()
                if "UnresolvedIdentifier" in kind:
                    raise Refused(fixed.FORBIDDEN)
                if kind == "UnresolvedFunction" and part.nameParts().last().lower() in fixed.FORBIDDEN_FUNCTIONS:
                    raise Refused(fixed.FORBIDDEN)
        return plan

    def open(self, text: str, own: Collection[str], allowed: Collection[str] | None = None) -> DataFrame:
        """The analysed, unexecuted query, if all it reads are views among ``own`` and,
        where a whitelist is given, among ``allowed``."""
        plan = self.parse(text)
        known = {n.lower() for n in own}
        named = {tuple(_strings(n.multipartIdentifier())) for n in _nodes(plan) if n.getClass().getSimpleName() == "UnresolvedRelation"}
        catalog = self.spark.catalog
        foreign = sorted(".".join(n) for n in named if len(n) > 1 or (n[0].lower() not in known and catalog.tableExists(n[0])))
        if foreign:
            raise Refused(fixed.FOREIGN_TABLES + ", ".join(foreign))
        dataset = self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan)
        views, strangers = set(), set()
        _reads(dataset.queryExecution().analyzed(), views, strangers)
        strangers |= {v for v in views if v not in known}
        if strangers:
            raise Refused(fixed.FOREIGN_TABLES + ", ".join(sorted(strangers)))
        blocked = sorted(v for v in views if allowed is not None and v not in {a.lower() for a in allowed})
        if blocked:
            raise Refused(fixed.DISABLED_TABLES + ", ".join(blocked))
        return DataFrame(dataset, self.spark)

    def _is(self, node: JavaObject, name: str) -> bool:
        forName = self.spark._jvm.java.lang.Class.forName
        try:
            return forName(name).isInstance(node)
        except Py4JJavaError:  # this version of Spark has no such interface
            return False


def _items(sequence: JavaObject) -> Iterator[JavaObject]:
    walk = sequence.iterator()
    while walk.hasNext():
        yield walk.next()


def _strings(sequence: JavaObject) -> list[str]:
    return [str(x) for x in _items(sequence)]


def _expressions(node: JavaObject) -> Iterator[JavaObject]:
    todo = list(_items(node.expressions()))
    while todo:
        part = todo.pop()
        yield part
        todo += _items(part.children())


def _below(node: JavaObject) -> list[JavaObject]:
    """Children, the plans of WITH parts, and those of subqueries."""
    found = list(_items(node.children()))
    if node.getClass().getSimpleName() == "UnresolvedWith":
        found += [part._2() for part in _items(node.cteRelations())]
    for part in _expressions(node):
        if hasattr(part, "plan") and "SubqueryExpression" in _lineage(part):
            found.append(part.plan())
    return found


def _lineage(part: JavaObject) -> set[str]:
    names, kind = set(), part.getClass()
    while kind is not None:
        names.add(kind.getSimpleName())
        kind = kind.getSuperclass()
    return names


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _below(node)


def _reads(plan: JavaObject, views: set[str], strangers: set[str]) -> None:
    """Temporary views an analysed plan reads, and whatever else it reads."""
    todo = [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "View" and node.isTempView():
            views.add(node.desc().identifier().table().lower())
            continue  # what a view of ours reads is ours
        below = _below(node)
        if not below and kind not in _CONSTANT_LEAVES:
            strangers.add(kind)
        todo += below
