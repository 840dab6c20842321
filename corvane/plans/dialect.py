"""The few places where the SQL of Spark and DuckDB differ."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    duck: bool

    def joined(self, x: str, sep: str = ",") -> str:
        """Aggregate: distinct strings in order, joined."""
        return f"string_agg(DISTINCT {x}, '{sep}' ORDER BY {x})" if self.duck else f"array_join(array_sort(collect_set({x})), '{sep}')"

    def listed(self, x: str, order: str, sep: str = ",") -> str:
        """Aggregate: strings in the order of another column, joined."""
        return f"string_agg({x}, '{sep}' ORDER BY {order})" if self.duck else f"listagg({x}, '{sep}') WITHIN GROUP (ORDER BY {order})"

    def each(self, array: str) -> str:
        return f"unnest({array})" if self.duck else f"explode({array})"

    def words(self, text: str) -> str:
        return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')" if self.duck else f"regexp_extract_all(lower({text}), r'(?U)\\w+', 0)"

    def find(self, text: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract_all({text}, '{pattern}', {group})" if self.duck else f"regexp_extract_all({text}, r'{pattern}', {group})"

    def first(self, text: str, pattern: str, group: int = 1) -> str:
        return f"regexp_extract({text}, '{pattern}', {group})" if self.duck else f"regexp_extract({text}, r'{pattern}', {group})"

    def like(self, text: str, pattern: str) -> str:
        return f"regexp_matches({text}, '{pattern}')" if self.duck else f"({text} RLIKE r'{pattern}')"

    def replaced(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, '{pattern}', '{by}', 'g')" if self.duck else f"regexp_replace({text}, r'{pattern}', '{by}')"

    def div(self, a: str, b: str) -> str:
        return f"(({a}) // ({b}))" if self.duck else f"(({a}) div ({b}))"

    def lines(self, text: str) -> str:
        """A generator of (ord, line), ord from 1; used as a lateral source."""
        return f"string_split({text}, chr(10))" if self.duck else f"split({text}, '\\n')"

    def seconds(self, later: str, earlier: str) -> str:
        return f"date_diff('second', date_trunc('second', {earlier}), date_trunc('second', {later}))" if self.duck else f"timestampdiff(SECOND, date_trunc('SECOND', {earlier}), date_trunc('SECOND', {later}))"

    def rows_of(self, array: str, keys: str, source: str) -> str:
        """A subquery of `keys`, ord (from 1) and item."""
        if self.duck:
            return f"(SELECT {keys}, unnest(range(1, len({array}) + 1)) AS ord, unnest({array}) AS item FROM {source})"
        return f"(SELECT {keys}, CAST(pos + 1 AS BIGINT) AS ord, item FROM {source} LATERAL VIEW posexplode({array}) x AS pos, item)"


SPARK, DUCK = Dialect(False), Dialect(True)
Sql = Callable[[Dialect], str]
