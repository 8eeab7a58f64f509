"""Field extraction from pages by a declarative specification.

A path is a chain of simple selectors ('tag', '.class', '#id', 'tag.class') in which each matches a
descendant of the one before. The extractor runs on executors in Arrow batches and returns text
only; numbers, times and ordinals are native expressions on its output.
"""

from __future__ import annotations

import re
from collections import defaultdict, deque
from dataclasses import dataclass, field
from html import parser as html_parser
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Field:
    """Text of the first match (or attribute ``attr`` of it); ``many`` keeps every match."""

    name: str
    path: str
    attr: str | None = None
    many: bool = False


@dataclass(frozen=True)
class Records:
    """A list of records: one per match of ``path``, fields looked up inside the match."""

    name: str
    path: str
    fields: tuple[Field, ...]


@dataclass(frozen=True)
class Spec:
    fields: tuple[Field, ...] = ()
    records: tuple[Records, ...] = ()

    def schema(self) -> str:
        plain = [f"{f.name} {'array<string>' if f.many else 'string'}" for f in self.fields]
        nested = [
            f"{r.name} array<struct<{', '.join(f'{f.name}: string' for f in r.fields)}>>" for r in self.records
        ]
        return ", ".join([*plain, *nested])

    def arrow_fields(self) -> list[pa.Field]:
        text = pa.string()
        plain = [pa.field(f.name, pa.list_(text) if f.many else text) for f in self.fields]
        nested = [
            pa.field(r.name, pa.list_(pa.struct([pa.field(f.name, text) for f in r.fields]))) for r in self.records
        ]
        return [*plain, *nested]


_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES_ITSELF = frozenset("p li tr td th option dt dd".split())
_CONTAINERS = frozenset("table ul ol dl select div article section body".split())
#: Elements whose content is no markup. Which others there are depends on the parser's version.
_RAW = frozenset((*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"))
_RAW_END = {name: re.compile(rf"</{name}[ \t\n]*>", re.I) for name in ("script", "style")}
#: The markup that every version of the parser reads alike: end tags, start tags, document types, closed comments.
_ATTRIBUTES = r"""(?:[ \t\n]++[a-zA-Z][\w:-]*+(?:="[^"]*+"|='[^']*+')?+)*+"""
_TOKEN = re.compile(
    rf"</([a-zA-Z][a-zA-Z0-9-]*+)[ \t\n]*+>|<([a-zA-Z][a-zA-Z0-9-]*+)({_ATTRIBUTES})[ \t\n]*+(/?)>"
    r"|<!(?:[dD][oO][cC][tT][yY][pP][eE][^<>]*+>|--(?!-?>)[^-]*+(?:-[^-]++)*+-->)", re.ASCII)
_unescape_value = getattr(html_parser, "_unescape_attrvalue", unescape)
_MARKUP = re.compile(r"(<[^<>]*+>)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)(?:="([^"]*)"|='([^']*)')?""", re.ASCII)
#: Distinct texts kept in a memo, and the longest tag that is kept.
_KNOWN, _KNOWN_CHARS = 10_000, 200
#: Pages whose texts and records are held as Python objects at once.
_ROWS = 500
#: Deepest open element that moves are kept for, the most that are kept, and that one page may add.
_DEEP, _MOVES, _NEW_MOVES = 256, 20_000, 1_000
_STEP = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")


def _steps(path: str) -> list[tuple[str | None, frozenset[str], str | None]]:
    steps = []
    for part in path.split():
        tag, marks = _STEP.match(part).groups()
        classes = frozenset(mark[1:] for mark in re.findall(r"\.[\w-]+", marks))
        ids = re.findall(r"#([\w-]+)", marks)
        steps.append((tag.lower() if tag else None, classes, ids[0] if ids else None))
    return steps


class _Steps:
    """The steps of many paths as bits: one bit a step, set in ``fits`` where an element fits that step.

    The state of an open element has the bits of the steps that can come next: bit j of a path stands for its first
    j steps having been matched by the element and its ancestors, in order. A state never loses bits on the way down.
    """

    def __init__(self, paths: list[str]):
        self.tests, self.ends, self.start = [], {}, 0
        for path in dict.fromkeys(paths):
            steps = _steps(path)
            self.start |= 1 << len(self.tests)
            self.tests += steps
            self.ends[path] = 1 << len(self.tests) - 1
        self.last = sum(self.ends.values())
        self.known: dict[tuple, int] = {}

    def fits(self, tag: str, classes: str, ident: str | None) -> int:
        key = tag, classes, ident
        mask = self.known.get(key)
        if mask is None:
            own = frozenset(classes.split())
            mask = sum(1 << k for k, (t, c, i) in enumerate(self.tests)
                       if (t is None or t == tag) and c <= own and (i is None or i == ident))
            if len(self.known) > _KNOWN:
                self.known.clear()
            self.known[key] = mask
        return mask

    def below(self, state: int, mask: int) -> tuple[int, int]:
        """The ends of the paths that an element completes, and the state of its children."""
        hit = state & mask
        return hit & self.last, state | (hit & ~self.last) << 1


@dataclass(frozen=True)
class _Plan:
    """A specification with its paths compiled: those from the page's root, and those from a record's element.

    Paths from a record's element are matched for all open records at once: a match within an inner record is one
    within every record around it, so for each number of steps only the deepest start that has them is kept.
    """

    spec: Spec
    outer: _Steps
    inner: _Steps
    lengths: dict[str, int]
    tags: dict[str, tuple] = field(default_factory=dict)  # markup seen before, read once
    hits: dict[int, tuple] = field(default_factory=dict)  # what an element completes, by its bits
    single: dict[int, tuple | None] = field(default_factory=dict)

    @classmethod
    def of(cls, spec: Spec) -> _Plan:
        outer = [*(f.path for f in spec.fields), *(r.path for r in spec.records)]
        inner = [f.path for r in spec.records for f in r.fields if f.path]
        return cls(spec, _Steps(outer), _Steps(inner), {p: len(_steps(p)) for p in inner})

    def tag(self, name: str, named: dict) -> tuple:
        """(tag, attributes, its bits on outer and inner paths) of a start tag."""
        classes, ident = named.get("class", ""), named.get("id")
        return name, named, self.outer.fits(name, classes, ident), self.inner.fits(name, classes, ident)

    def token(self, match: re.Match) -> tuple:
        """(end tag or None, start tag or None, whether that is closed at once) of a piece of markup."""
        ended, name, attributes, closed = match.groups()
        if name:
            named = {}
            for key, double, single in _ATTRIBUTE.findall(attributes):
                named[key.lower()] = _unescape_value(double or single)
            read = None, self.tag(name.lower(), named), bool(closed)
        else:
            read = ended and ended.lower(), None, False
        if match.end() - match.start() <= _KNOWN_CHARS:
            if len(self.tags) > _KNOWN:
                self.tags.clear()
            self.tags[match.group()] = read
        return read

    def completed(self, hit: int) -> tuple:
        """Fields of the page, and records with their number, whose paths an element completes."""
        found = self.hits.get(hit)
        if found is None:
            fields = [f for f in self.spec.fields if hit & self.outer.ends[f.path]]
            records = [(k, r) for k, r in enumerate(self.spec.records) if hit & self.outer.ends[r.path]]
            found = self.hits[hit] = fields, records
        return found

    def one_step(self, mask: int) -> tuple | None:
        """The record fields that an element fits, if all paths with a fitting step have one step; else None."""
        if mask not in self.single:
            fits = {p for p, n in self.lengths.items() if mask // (self.inner.ends[p] >> n - 1) & (1 << n) - 1}
            found = None
            if all(self.lengths[p] == 1 for p in fits):
                found = tuple((k, i, f) for k, r in enumerate(self.spec.records) for i, f in enumerate(r.fields) if f.path in fits)
            if len(self.single) > _KNOWN:
                self.single.clear()
            self.single[mask] = found
        return self.single[mask]


class _Reader(HTMLParser):
    """Walks one page and fills ``values`` in time linear in the page, however deep its elements nest.

    A stack element holds its tag, its state on the outer paths and the starts of the inner ones. Text is collected
    once for all open captures; a capture is a place in it. Records that still lack a field wait in order of depth,
    and an element that matches takes the outermost of them: each waits once.
    """

    def __init__(self, plan: _Plan):
        super().__init__(convert_charrefs=True)
        self.plan, spec = plan, plan.spec
        self.stack: list[tuple[str, int, dict]] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # open elements by tag
        self.containers: list[int] = []
        self.pieces: list[str] = []
        self.captures: list[tuple[int, int, Field, list[dict]]] = []  # depth, first piece, field, targets
        self.rows: list[list[tuple[int, dict]]] = [[] for _ in spec.records]  # open ones
        self.deepest = 0  # depth of the innermost open record
        self.waiting = [[deque() for _ in r.fields] for r in spec.records]
        self.open: set[str] = set()  # fields of the page that are being captured
        self.values = {f.name: [] if f.many else None for f in spec.fields}
        self.values.update({r.name: [] for r in spec.records})

    def _capture(self, field: Field, targets: list[dict]) -> None:
        self.captures.append((len(self.stack), len(self.pieces), field, targets))

    @staticmethod
    def _put(target: dict, field: Field, value: str) -> None:
        if field.many:
            target[field.name].append(value)
        elif target.get(field.name) is None:
            target[field.name] = value

    def _page_fields(self, fields: list[Field], named: dict) -> None:
        for field in fields:
            if field.attr is not None:
                if named.get(field.attr) is not None:
                    self._put(self.values, field, named[field.attr])
            elif (field.many or self.values[field.name] is None) and field.name not in self.open:
                self.open.add(field.name)
                self._capture(field, [self.values])

    def _new_records(self, found: list[tuple[int, Records]], named: dict) -> None:
        self.deepest = depth = len(self.stack)
        for k, records in found:
            row = {f.name: None for f in records.fields}
            self.values[records.name].append(row)
            self.rows[k].append((depth, row))
            for field, waiting in zip(records.fields, self.waiting[k], strict=True):
                if field.path:
                    waiting.append((depth, row))
                elif field.attr is None:
                    self._capture(field, [row])
                elif named.get(field.attr) is not None:
                    row[field.name] = named[field.attr]

    def _take_waiting(self, field: Field, waiting: deque, deepest: int, named: dict) -> None:
        """The element gives ``field`` to all records that wait for it and start at ``deepest`` or above."""
        value = named.get(field.attr) if field.attr is not None else None
        if field.attr is not None and value is None:
            return
        targets = []
        while waiting and waiting[0][0] <= deepest:
            targets.append(waiting.popleft()[1])
        if field.attr is None:
            self._capture(field, targets)
        else:
            for row in targets:
                row[field.name] = value

    def _record_fields(self, mask: int, named: dict, starts: dict) -> dict:
        """Fills the records around the element; returns the deepest starts of the paths for its children."""
        inner, place, after = self.plan.inner, len(self.stack) - 1, starts
        reached = {}  # by path: a record matches if it starts at this depth or above
        for path, n in self.plan.lengths.items():
            own = mask // (inner.ends[path] >> n - 1) & (1 << n) - 1
            if not own:
                continue
            before = starts.get(path, ())
            if own >> n - 1:
                deepest = min(before[n - 2], place) if n > 1 and len(before) >= n - 1 else place if n == 1 else -1
                if deepest >= 0:
                    reached[path] = deepest
            if n > 1:
                now = list(before) + [-1] * (n - 1 - len(before))
                for j in range(n - 1):
                    if own >> j & 1:
                        now[j] = max(now[j], min(before[j - 1] if j and len(before) >= j else -1 if j else place, place))
                after = {**after, path: tuple(now)}
        for k, records in enumerate(self.plan.spec.records if reached else ()):
            for field, waiting in zip(records.fields, self.waiting[k], strict=True):
                deepest = reached.get(field.path, -1)
                if deepest >= 0 and waiting and waiting[0][0] <= deepest:
                    self._take_waiting(field, waiting, deepest, named)
        return after

    def handle_starttag(self, tag, attrs):
        self._start(self.plan.tag(tag, {name: value or "" for name, value in attrs}))

    def _start(self, read: tuple) -> None:
        tag, named, fits, mask = read
        if tag in _CLOSES_ITSELF and self.at.get(tag):
            last = self.at[tag][-1]
            if not self.containers or last > self.containers[-1]:
                self._close_to(last)
        place = len(self.stack)
        _, state, starts = self.stack[-1] if place else ("", self.plan.outer.start, {})
        hit = 0
        if state & fits:
            hit, state = self.plan.outer.below(state, fits)
        self.at[tag].append(place)
        if tag in _CONTAINERS:
            self.containers.append(place)
        self.stack.append((tag, state, starts))
        if hit:
            fields, records = self.plan.completed(hit)
            if records:
                self._new_records(records, named)
            if fields:
                self._page_fields(fields, named)
        if mask and self.deepest:
            single = self.plan.one_step(mask)
            if single is None:
                after = self._record_fields(mask, named, starts)
                if after is not starts:
                    self.stack[-1] = tag, state, after
            else:
                for k, i, field in single:
                    waiting = self.waiting[k][i]
                    if waiting and waiting[0][0] <= place:
                        self._take_waiting(field, waiting, place, named)
        if tag in _VOID:
            self._close_to(place)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close_to(len(self.stack) - 1)

    def handle_endtag(self, tag):
        if self.at.get(tag):
            self._close_to(self.at[tag][-1])

    def handle_data(self, data):
        if self.captures and self.stack and self.stack[-1][0] not in ("script", "style"):
            self.pieces.append(data)

    def _close_to(self, depth: int) -> None:
        stack, captures = self.stack, self.captures
        while len(stack) > depth:
            tag = stack.pop()[0]
            self.at[tag].pop()
            if tag in _CONTAINERS:
                self.containers.pop()
        while captures and captures[-1][0] > depth:
            _, first, field, targets = captures.pop()
            text = " ".join("".join(self.pieces[first:]).split())
            for target in targets:
                self._put(target, field, text)
            if targets[0] is self.values:
                self.open.discard(field.name)
        if self.pieces and not captures:
            self.pieces.clear()
        if self.deepest <= depth:
            return
        for k, rows in enumerate(self.rows):
            if not rows or rows[-1][0] <= depth:  # those that wait are open ones
                continue
            while rows and rows[-1][0] > depth:
                rows.pop()
            for some in self.waiting[k]:
                while some and some[-1][0] > depth:
                    some.pop()
        self.deepest = max((rows[-1][0] for rows in self.rows if rows), default=0)

    def plain(self, text: str) -> bool:
        """Reads a page of plain markup; False where a page holds other, which the parser has to read anew.

        The parser's events in the same order, without its steps in between: markup read before is known.
        """
        known, token = self.plan.tags, self.plan.token
        parts, at = _MARKUP.split(text), 1  # texts, and markup between them
        if "<" in parts[-1]:
            return False
        while at < len(parts):
            data, markup = parts[at - 1], parts[at]
            if "<" in data:
                return False
            if data and self.captures:
                self.handle_data(unescape(data))
            read = known.get(markup)
            if read is None:
                match = _TOKEN.fullmatch(markup)
                if match is None:
                    return False
                read = token(match)
            ended, start, closed = read
            at += 2
            if ended is not None:
                places = self.at.get(ended)
                if places:
                    self._close_to(places[-1])
            elif start is not None:
                tag = start[0]
                if tag in _RAW and not closed:
                    last = at
                    while tag in _RAW_END and last < len(parts) and not _RAW_END[tag].fullmatch(parts[last]):
                        last += 2
                    inside = "".join(parts[at - 1 : last])
                    if tag not in _RAW_END or last >= len(parts) or "</" in inside or "<!" in inside:
                        return False
                    parts[last - 1], at = "", last
                self._start(start)
                if closed and tag not in _VOID:
                    self._close_to(len(self.stack) - 1)
        if self.captures:
            self.handle_data(unescape(parts[-1]))
        return True

    def finish(self) -> dict:
        self.close()
        self._close_to(0)
        return self.values


class _State:
    """What a reader has open: elements, captures, records and the fields they still lack. Equal ones are one object.

    ``moves`` leads from a kind of markup to the next state and to what is done on the way.
    """

    __slots__ = ("stack", "captures", "rows", "filled", "catching", "moves")

    def __init__(self, stack: tuple, captures: tuple, rows: tuple, filled: frozenset):
        self.stack = stack  # (tag, state on the outer paths)
        self.captures = captures  # (depth, field of the page or None, ((place of the open record, field), ...))
        self.rows = rows  # open records: (kind, depth, fields that wait)
        self.filled = filled  # fields of the page that have a value
        self.catching = bool(captures and stack and stack[-1][0] not in ("script", "style"))
        self.moves: dict[int, tuple[_State, tuple]] = {}


#: What is done on a move.
_TEXT, _BEGIN, _ROW, _ROW_ENDS, _ROW_ATTRIBUTE, _PAGE_ATTRIBUTE = range(6)


class _Moves:
    """Reads pages of plain markup as ``_Reader`` does, with every step it has taken before kept as a move.

    What a piece of markup does depends on its kind (its tag, the steps it fits, the attributes it has) and on what is
    open; the rows of a list all start from the same state, so their steps are worked out once. Only for
    specifications whose record fields are one step below their record, and for pages that are not deeper than
    ``_DEEP``; others are left to ``_Reader``.
    """

    OTHER_MARKUP, LEFT = "other markup", "left"

    def __init__(self, plan: _Plan):
        self.plan, self.spec = plan, plan.spec
        fields = [*self.spec.fields, *(f for r in self.spec.records for f in r.fields)]
        self.names = tuple(dict.fromkeys(f.attr for f in fields if f.attr is not None))
        self.usable = all(n == 1 for n in plan.lengths.values())
        self.begun = 0
        self._begin()

    def _begin(self) -> None:
        self.begun += 1
        self.made = 0  # moves
        self.kinds: dict[tuple, int] = {}
        self.told: list[tuple] = []  # what a kind stands for: the tag, and of a start tag all that matters
        self.known: dict[str, tuple] = {}
        self.shapes: dict[tuple, tuple | None] = {}
        self.states: dict[tuple, _State] = {}
        self.first = self._state((), (), (), frozenset())

    def _state(self, *key) -> _State:
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = _State(*key)
        return state

    def _kind(self, told: tuple) -> int:
        kind = self.kinds.get(told)
        if kind is None:
            kind = self.kinds[told] = len(self.told)
            self.told.append(told)
        return kind

    def _shape(self, parts: tuple) -> tuple | None:
        """Where a start tag has its values, from its text around them; None for other markup."""
        match = _TOKEN.fullmatch(f"<{'""'.join(parts)}>")
        if match is None or not match[2]:
            return None
        at, named = 1, {}
        for key, value in re.findall(r"""([a-zA-Z][\w:-]*)(="")?""", match[3], re.ASCII):
            named[key.lower()] = at if value else None
            at += 2 if value else 0
        has = tuple(name in named for name in self.names)
        places = tuple(named.get(name) for name in self.names)  # None: a name alone, or not there
        return named.get("class", -1), named.get("id", -1), places, any(has), {}, (match[2].lower(), has, bool(match[4]))

    def token(self, markup: str) -> tuple | None:
        """(kind, values of the wanted attributes) of the markup in '<' and '>'; None where it is not plain."""
        parts = markup.split('"')
        if len(parts) > 1 and "'" not in markup:
            key = tuple(parts[::2])
            shape = self.shapes.get(key, self)
            if shape is self:
                if len(self.shapes) > _KNOWN:
                    self.shapes.clear()
                shape = self.shapes[key] = self._shape(key)
            if shape is not None:
                if "&" in markup:
                    parts = [_unescape_value(part) for part in parts]
                at_class, at_id, places, wanted, kinds, (tag, has, closed) = shape
                classes = "" if at_class in (-1, None) else parts[at_class]
                ident = None if at_id == -1 else "" if at_id is None else parts[at_id]
                kind = kinds.get((classes, ident))
                if kind is None:
                    if len(kinds) > _KNOWN:
                        kinds.clear()
                    fits, mask = self.plan.outer.fits(tag, classes, ident), self.plan.inner.fits(tag, classes, ident)
                    kind = kinds[classes, ident] = self._kind((tag, fits, mask, has, closed))
                read = kind, ["" if at is None else parts[at] for at in places] if wanted else ()
                if not wanted:  # values that are wanted are seldom the same again
                    self._keep(markup, read)
                return read
        match = _TOKEN.fullmatch(f"<{markup}>")
        if match is None:
            return None
        ended, start, closed = self.plan.token(match)
        if start is not None:
            tag, named, fits, mask = start
            kind = self._kind((tag, fits, mask, tuple(name in named for name in self.names), closed))
            read = kind, [named.get(name) for name in self.names]
        else:
            read = self._kind((ended or "",)), ()  # comments and document types end nothing
        self._keep(markup, read)
        return read

    def _keep(self, markup: str, read: tuple) -> None:
        if len(markup) <= _KNOWN_CHARS:
            if len(self.known) > _KNOWN:
                self.known.clear()
            self.known[markup] = read

    @staticmethod
    def _closed(depth: int, stack: tuple, captures: list, rows: list, filled: set, ops: list, many: tuple) -> tuple:
        while captures and captures[-1][0] > depth:
            _, page, targets = captures.pop()
            ops.append((_TEXT, page, targets, not captures))
            if page is not None and not many[page]:
                filled.add(page)
        while rows and rows[-1][1] > depth:
            rows.pop()
            ops.append((_ROW_ENDS,))
        return stack[:depth]

    def _move(self, state: _State, kind: int) -> tuple[_State, tuple]:
        """The steps of ``_Reader`` for a kind of markup."""
        stack, captures, rows, filled = state.stack, list(state.captures), list(state.rows), set(state.filled)
        many, ops, told = tuple(f.many for f in self.spec.fields), [], self.told[kind]
        tag = told[0]
        places = [at for at, (name, _) in enumerate(stack) if name == tag]
        if len(told) == 1:
            if places:
                stack = self._closed(places[-1], stack, captures, rows, filled, ops, many)
            return self._state(stack, tuple(captures), tuple(rows), frozenset(filled)), tuple(ops)
        _, fits, mask, has, closed = told
        if tag in _CLOSES_ITSELF and places:
            if not any(name in _CONTAINERS for name, _ in stack[places[-1] + 1 :]):
                stack = self._closed(places[-1], stack, captures, rows, filled, ops, many)
        place, hit = len(stack), 0
        outer = stack[-1][1] if place else self.plan.outer.start
        if outer & fits:
            hit, outer = self.plan.outer.below(outer, fits)
        stack, depth, older = (*stack, (tag, outer)), place + 1, len(rows)
        if hit:
            fields, records = self.plan.completed(hit)
            for k, record in records:
                rows.append((k, depth, frozenset(i for i, f in enumerate(record.fields) if f.path)))
                ops.append((_ROW, k, len(record.fields)))
                for i, f in enumerate(record.fields):
                    if f.path:
                        continue
                    if f.attr is None:
                        captures.append((depth, None, ((len(rows) - 1, i),)))
                        ops.append((_BEGIN,))
                    elif has[self.names.index(f.attr)]:
                        ops.append((_ROW_ATTRIBUTE, self.names.index(f.attr), ((len(rows) - 1, i),)))
            for f in fields:
                at = self.spec.fields.index(f)
                if f.attr is not None:
                    if has[self.names.index(f.attr)]:
                        ops.append((_PAGE_ATTRIBUTE, self.names.index(f.attr), at))
                        if not f.many:
                            filled.add(at)
                elif (f.many or at not in filled) and all(page != at for _, page, _ in captures):
                    captures.append((depth, at, ()))
                    ops.append((_BEGIN,))
        for k, i, f in (self.plan.one_step(mask) or ()) if mask else ():
            if f.attr is not None and not has[self.names.index(f.attr)]:
                continue
            targets = tuple((at, i) for at, row in enumerate(rows[:older]) if row[0] == k and i in row[2])
            if not targets:
                continue
            for at, _ in targets:
                rows[at] = (k, rows[at][1], rows[at][2] - {i})
            if f.attr is not None:
                ops.append((_ROW_ATTRIBUTE, self.names.index(f.attr), targets))
            else:
                captures.append((depth, None, targets))
                ops.append((_BEGIN,))
        if tag in _VOID or closed:
            stack = self._closed(place, stack, captures, rows, filled, ops, many)
        return self._state(stack, tuple(captures), tuple(rows), frozenset(filled)), tuple(ops)

    def read(self, text: str) -> tuple[list, list] | str:
        """Values of the page's fields, and the rows of its records; or why the page is not read here."""
        if not self.usable:
            return self.LEFT
        if self.made > _MOVES or len(self.told) > _KNOWN:
            self._begin()
            self.usable = self.begun < 4  # else pages have too little in common
        known, told, many = self.known, self.told, [f.many for f in self.spec.fields]
        values: list = [[] if m else None for m in many]
        records: list[list] = [[] for _ in self.spec.records]
        pieces, firsts, opened, left = [], [], [], _NEW_MOVES
        state, (_, *parts) = self.first, text.split("<")
        for part in parts:
            markup, ended, data = part.partition(">")
            read = known.get(markup) or self.token(markup)
            if not ended or read is None:
                return self.OTHER_MARKUP
            kind, named = read
            move = state.moves.get(kind)
            if move is None:
                tag, *start = told[kind]
                if start and not start[-1] and tag in _RAW:
                    return self.LEFT if tag in _RAW_END else self.OTHER_MARKUP
                left -= 1
                self.made += 1
                if not left or len(state.stack) >= _DEEP:
                    return self.LEFT
                move = state.moves[kind] = self._move(state, kind)
            state, ops = move
            for op in ops:
                what = op[0]
                if what == _BEGIN:
                    firsts.append(len(pieces))
                elif what == _TEXT:
                    value = " ".join("".join(pieces[firsts.pop() :]).split())
                    _, page, targets, done = op
                    for place, i in targets:
                        if opened[place][i] is None:
                            opened[place][i] = value
                    if page is not None:
                        if many[page]:
                            values[page].append(value)
                        elif values[page] is None:
                            values[page] = value
                    if done:
                        pieces.clear()
                elif what == _ROW_ATTRIBUTE:
                    for place, i in op[2]:
                        opened[place][i] = named[op[1]]
                elif what == _ROW:
                    row = [None] * op[2]
                    records[op[1]].append(row)
                    opened.append(row)
                elif what == _ROW_ENDS:
                    opened.pop()
                elif many[op[2]]:
                    values[op[2]].append(named[op[1]])
                elif values[op[2]] is None:
                    values[op[2]] = named[op[1]]
            if state.catching and data:
                pieces.append(unescape(data) if "&" in data else data)
        if state.captures:  # still open at the end
            for _, page, targets in reversed(state.captures):
                value = " ".join("".join(pieces[firsts.pop() :]).split())
                for place, i in targets:
                    if opened[place][i] is None:
                        opened[place][i] = value
                if page is not None:
                    if many[page]:
                        values[page].append(value)
                    elif values[page] is None:
                        values[page] = value
        return values, records


def _column(values: list, kind: pa.DataType, fields: int = 0) -> pa.Array:
    """A column of fields, or of lists of records (each a list of its ``fields`` values)."""
    if not fields:
        return pa.array(values, kind)
    ends, rows = [0], []
    for found in values:
        rows += found or ()
        ends.append(len(rows))
    starts = [None if found is None else start for found, start in zip(values, ends[:-1], strict=True)]
    columns = list(zip(*rows, strict=True)) or [()] * fields
    inner = kind.value_type
    texts = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in columns], fields=list(inner))
    return pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), texts, type=kind)


def extract(pages: DataFrame, spec: Spec, keep: tuple[str, ...] = ("url",), html: str = "html") -> DataFrame:
    """Adds the fields of ``spec`` and ``problem`` to the kept columns of each page.

    A page that cannot be read to its end has a text in ``problem`` and the fields that were complete by then; it
    never ends the job.
    """
    kept = pages.select(*keep, html)
    plan = _Plan.of(spec)
    out_schema = ", ".join(
        [*[f"{c} {kept.schema[c].dataType.simpleString()}" for c in keep], spec.schema(), "problem string"]
    )
    fields = pa.struct([*spec.arrow_fields(), pa.field("problem", pa.string())])

    shapes = [*((f.name, 0, ()) for f in spec.fields), *((r.name, len(r.fields), [f.name for f in r.fields]) for r in spec.records)]

    def parsed(text: str, plain: bool) -> tuple[dict, str | None]:
        reader = _Reader(plan)
        try:
            if not (plain and reader.plain(text)):
                reader = _Reader(plan)
                reader.feed(text)
            return reader.finish(), None
        except Exception as error:  # one page must not end the batch
            return reader.values, f"parse error: {error}"

    def run(batches):
        moves = _Moves(plan)

        def read(text: str | None) -> tuple:
            if not text:
                return *[None] * len(shapes), "parse error: empty page"
            found = moves.read(text)
            if not isinstance(found, str):
                return *found[0], *found[1], None
            values, problem = parsed(text, found == moves.LEFT)
            return *[[[row[n] for n in names] for row in values[name]] if number else values[name]
                     for name, number, names in shapes], problem

        for batch in (b.slice(k, _ROWS) for b in batches for k in range(0, b.num_rows, _ROWS)):
            columns = zip(*[read(text) for text in batch.column(len(keep)).to_pylist()], strict=True)
            found = [_column(list(c), f.type, number) for c, f, number in
                     zip(columns, fields, [*(number for _, number, _ in shapes), 0], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + found,
                names=[*keep, *[f.name for f in fields]],
            )

    return kept.mapInArrow(run, out_schema)


def by_class(*names: str) -> tuple[Field, ...]:
    """Fields named like the class of the element that holds them."""
    return tuple(Field(name, f".{name}") for name in names)


# Default specifications: each value stands in an element whose class is the field name. Pages
# with another structure need a specification of their own with the same field names.
RIDER = (Field("rider_name", ".rider"), Field("rider_url", ".rider", "href"))
TEAM = (Field("team_name", ".team"), Field("team_url", ".team", "href"))

STAGE_PAGE = Spec(
    fields=by_class(
        "distance", "vertical_meters", "profile_score", "profile_icon", "stage_type", "date", "departure", "arrival"
    ),
    records=(
        Records("climbs", ".climb", (Field("climb_name", "a"), Field("climb_url", "a", "href"), *by_class("category"))),
        Records("results", ".result", (*by_class("rank", "time", "status"), *RIDER, Field("team_name", ".team"))),
    ),
)
CLIMBS_PAGE = Spec(
    records=(
        Records(
            "climbs",
            ".climb",
            (
                Field("climb_name", "a"),
                Field("climb_url", "a", "href"),
                *by_class("length", "steepness", "top", "km_before_finnish", "km_before_finish"),
            ),
        ),
    )
)
STARTLIST_PAGE = Spec(
    fields=(Field("race_name", "h1"),),
    records=(Records("riders", ".entry", (*RIDER, *TEAM, *by_class("nationality", "rider_number"))),),
)
RACE_PAGE = Spec(fields=(Field("race_name", "h1"), Field("stage_urls", ".stages a", "href", many=True)))
RIDER_PAGE = Spec(fields=(Field("name", "h1"), *by_class("birthdate", "weight", "height", "nationality")))
RANKING_PAGE = Spec(records=(Records("ranking", ".result", (*by_class("rank", "points"), *RIDER, Field("team_name", ".team"))),))
