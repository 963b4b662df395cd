"""Vocabulary of a knowledge base: partitions, scopes, roles, statuses and naming, checked when built.

Everything here is a few dozen rows of configuration, so it lives on the driver: operators turn it into literals or
into small frames. default() holds fixed values that results depend on; load() reads a folder of configuration files.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CONFIG_VERSION = "1.0.0"

#: What the wildcards of a glob match; all else is itself.
_WILD = {"**": ".*", "*": "[^/]*", "?": "[^/]"}


class ConfigError(ValueError):
    """A configuration that contradicts itself."""


@dataclass(frozen=True)
class Partition:
    id: str
    label: str
    domain: str
    codeowner: str
    scope: str
    flavor: str
    path: str = ""
    default_role: str | None = None
    pairs_with: str | None = None


@dataclass(frozen=True)
class Role:
    """A dependent's role: the token that authors write, the artifact's key, the letter in ids, the layer by flavor."""

    role: str
    token: str
    graph_key: str
    letter: str
    layers: dict


@dataclass(frozen=True)
class Target:
    id: str
    scopes: tuple[str, ...]
    artifact: str
    exposure: str = "public"
    aliases: tuple[str, ...] = ()


# Fixed values, in natural order.
PARTITIONS = (
    Partition("core", "01 · Core Specs & Schemas", "spec", "@core-team", "public", "kernel"),
    Partition("adr", "02 · Architecture Decision Records", "adr", "@core-team", "public", "kernel"),
    Partition("ops", "07 · SOPs & Operations", "sop", "@ops-lead", "public", "policy"),
    Partition("exec", "03i · Executive Board & Strategy", "exec", "@board-exec", "private", "policy"),
    Partition("adr-internal", "02i · Internal ADRs & Security Post-Mortems", "adrint", "@core-team", "private", "kernel"),
    Partition("ops-internal", "07i · Internal SOPs & Operations", "opsint", "@ops-lead", "private", "policy"),
    Partition("axioms", "00 · System Axioms & Meta-Constitution", "axiom", "@board-exec", "private", "meta"),
    Partition("core-internal", "01i · Internal Core Specs & Security Architecture", "coreint", "@core-team", "private", "kernel"),
)
SCOPES = {"public": 0, "private": 10, "corporate": 5}
CONTRACT_LAYERS = {"kernel": "KERNEL_CONTRACT", "policy": "POLICY_CONTRACT", "meta": "META_CONSTITUTION"}
ROLES = (
    Role("debate", "ref", "debates", "d", {"kernel": "TECHNICAL_DEBATE", "policy": "POLICY_DEBATE", "meta": "META_DEBATE"}),
    Role("ops", "ops", "ops", "p", {"kernel": "OPERATIONAL_EXTENSIONS", "policy": "EXECUTION_CHECKLIST", "meta": "META_CHECKLIST"}),
    Role("evi", "evi", "evidence", "e", {"kernel": "TECHNICAL_EVIDENCE", "policy": "COMPLIANCE_EVIDENCE", "meta": "META_EVIDENCE"}),
)
TARGETS = (
    Target("public", ("public",), "public/data/graph.json"),
    Target("internal", ("public", "private"), "public/internal-data/graph-internal.json", "restricted", ("all",)),
)
STATUSES = ("draft", "pending", "active", "deprecated", "archived")
STRICTNESS = ("active", "pending", "draft", "deprecated", "archived")
INVALIDATING = ("deprecated", "archived")
INVALIDATED = "invalidated"
NOT_COMPLIANT = "ast_non_compliant"
NOT_IN_FORCE = ("deprecated", "archived", "invalidated", "ast_non_compliant")
DOCUMENT_ROLES = ("contract", "axiom", "debate", "ops")
FILE_ROLES = ("contract", "axiom", "debate", "ops", "evi")
SUBBLOCKS = ("c", "d", "p", "e")
ARCHIVED_REASONS = ("orphaned_dependency", "obsolete_logic", "superseded_contract", "merged_into_sibling", "duplicate_coverage")
REQUIRED_FIELDS = {"archived": ("archived_reason",), "deprecated": ("archived_reason", "superseded_by")}
ENUM_FIELDS = {"archived_reason": ARCHIVED_REASONS}
ANCHOR_FIELDS = ("superseded_by",)
MUTABLE_KEYS = ("status", "tags", "supersedes", "superseded_by")
UNINDEXED = {"axioms": "info", "ops-internal": "info", "core-internal": "warn"}
LEVELS = ("info", "warn", "fail")
#: What a configurable pattern captures: the names of its groups in order, or how many are read by position.
CAPTURES = {
    "spec_anchor": ("id",),
    "heading": 2,
    "ref_callout_start": ("kind", "id", "title"),
    "blockquote_line": 1,
    "split_document": ("slug", "role", "lang"),
    "document_h1": 1,
    "frontmatter_fence": 0,
    "status_directive": ("status",),
    "subblock_suffix": 0,
    "loose_anchor_line": 1,
    "loose_ref_line": 1,
    "loose_admonition_open": 0,
    "loose_table_row": 0,
    "file_naming": ("slug", "role", "locale"),
}
SORTS = ("length_desc", "as_declared")


def glob_to_regex(pattern: str) -> str:
    """A path glob, segment by segment: * and ? stay inside a segment, ** crosses them. A segment that ends with ** takes
    the slash after it along, so what it stands for may be nothing; a last segment ** takes the directory itself too."""
    if not isinstance(pattern, str) or not pattern or pattern.startswith("/"):
        raise ConfigError(f"no glob of paths below the root: {pattern!r}")
    out, slash = "", ""
    *heads, last = (re.findall(r"\*\*|[*?]|[^*?]+", part) for part in pattern.split("/"))
    for tokens in heads:
        spans = tokens[-1:] == ["**"]
        out += slash + "".join(_WILD.get(t) or re.escape(t) for t in (tokens[:-1] if spans else tokens)) + ("(?:.*/)?" if spans else "")
        slash = "" if spans else "/"
    if last == ["**"] and slash:
        return f"^{out}(?:/.*)?$"
    return f"^{out}{slash}{''.join(_WILD.get(t) or re.escape(t) for t in last)}$"


def alternation(values, sort: str = SORTS[0]) -> str:
    """Longest first, so that no value hides one that it begins; or as declared."""
    values = list(dict.fromkeys(values))
    return "|".join(re.escape(v).replace("\\-", "-") for v in (sorted(values, key=len, reverse=True) if sort == SORTS[0] else values))


#: What counts in a template: escapes, parts, groups that capture, and where character classes begin and end.
_TOKEN = re.compile(r"\\.|\{(?P<part>[a-z_]+)\}|\(\?P<(?P<name>\w+)>|(?P<group>\((?!\?))|\[\^?\]?|\]", re.S)


def expanded(name: str, template: str, parts: dict[str, str]) -> str:
    """A pattern for Java from a template: read once from left to right, parts filled in and groups noted as they open.
    Parts capture nothing, so the groups are the template's own; columns read groups by number, so they lose their names.
    A part that is not known would match its own letters and nothing else, so it is refused."""
    if not isinstance(template, str) or not template:
        raise ConfigError(f"{name}: a pattern is a text that is not empty")
    out, groups, unknown, at, inside = [], [], [], 0, False
    for m in _TOKEN.finditer(template):
        out.append(template[at : m.start()])
        at, token = m.end(), m[0]
        if m["part"] and m["part"] not in parts:
            unknown.append(m["part"])
        elif m["part"]:
            token = parts[m["part"]]
        elif inside:
            inside = token != "]"
        elif token[0] == "[":
            inside = True
        elif m["name"] or m["group"]:
            groups.append(m["name"])
            token = "("
        out.append(token)
    made = "".join(out) + template[at:]
    if unknown:
        raise ConfigError(f"{name}: no such parts: {', '.join(sorted(set(unknown)))}")
    wanted = CAPTURES.get(name, len(groups))
    if (len(groups) if isinstance(wanted, int) else tuple(groups)) != wanted:
        raise ConfigError(f"{name}: it captures {groups}, and is read for {wanted}")
    try:
        re.compile(made)
    except re.error as e:
        raise ConfigError(f"{name}: no regular expression: {e}") from e
    return made


@dataclass(frozen=True)
class Config:
    partitions: tuple[Partition, ...] = PARTITIONS
    scopes: dict = field(default_factory=lambda: dict(SCOPES))
    roles: tuple[Role, ...] = ROLES
    targets: tuple[Target, ...] = TARGETS
    contract_layers: dict = field(default_factory=lambda: dict(CONTRACT_LAYERS))
    statuses: tuple[str, ...] = STATUSES
    strictness: tuple[str, ...] = STRICTNESS
    invalidating: tuple[str, ...] = INVALIDATING
    document_roles: tuple[str, ...] = DOCUMENT_ROLES
    file_roles: tuple[str, ...] = FILE_ROLES
    locales: tuple[str, ...] = ("vi", "en")
    suffixed: bool = True
    extensions: tuple[str, ...] = (".md",)
    ignore: tuple[str, ...] = ()
    root: str = "docs"
    staging: str = "drafts"
    separator: str = "#"
    subblocks: tuple[str, ...] = SUBBLOCKS
    dependent_roles: tuple[str, ...] = ("debate", "ops", "evi")
    required_fields: dict = field(default_factory=lambda: dict(REQUIRED_FIELDS))
    enum_fields: dict = field(default_factory=lambda: dict(ENUM_FIELDS))
    anchor_fields: tuple[str, ...] = ANCHOR_FIELDS
    mutable_keys: tuple[str, ...] = MUTABLE_KEYS
    unindexed: dict = field(default_factory=lambda: dict(UNINDEXED))
    unindexed_default: str = "warn"
    lifecycle_severity: str = "fail"
    naming_severity: str = "warn"
    patterns: dict = field(default_factory=dict)  # name -> template, in place of the ones below
    lock_enforced: bool = True  # whether the payload lock stops a commit, or only warns
    domain_sort: str = SORTS[0]
    kind_sort: str = SORTS[0]

    def __post_init__(self):
        object.__setattr__(self, "partitions", tuple(p if p.path else replace(p, path=f"{self.root}/{p.scope}/{p.id}") for p in self.partitions))
        self.check()

    def check(self) -> None:
        def unique(what, values):
            values = list(values)
            if len(set(values)) < len(values):
                raise ConfigError(f"duplicate {what}: {sorted(v for v in set(values) if values.count(v) > 1)}")

        for what, values in (("partition id", (p.id for p in self.partitions)), ("domain", (p.domain for p in self.partitions)), ("role", (r.role for r in self.roles)), ("token", (r.token for r in self.roles)), ("letter", (r.letter for r in self.roles)), ("graph key", (r.graph_key for r in self.roles)), ("target", (n for t in self.targets for n in (t.id, *t.aliases)))):
            unique(what, values)
        for p in self.partitions:
            if p.scope not in self.scopes:
                raise ConfigError(f"{p.id}: unknown scope {p.scope}")
            if p.flavor not in self.contract_layers:
                raise ConfigError(f"{p.id}: unknown flavor {p.flavor}")
            if p.pairs_with and p.pairs_with not in {q.id for q in self.partitions}:
                raise ConfigError(f"{p.id}: pairs_with names no partition")
        paths = sorted(p.path.split("/") for p in self.partitions)  # by parts, what lies inside a directory follows it
        for a, b in zip(paths, paths[1:]):
            if b[: len(a)] == a:
                raise ConfigError(f"directories overlap: {'/'.join(a)}, {'/'.join(b)}")
        for r in self.roles:
            if not re.fullmatch("[A-Za-z0-9]+", r.token):
                raise ConfigError(f"token {r.token!r} is not alphanumeric")
            if r.letter not in self.subblocks:
                raise ConfigError(f"letter {r.letter!r} is not a sub-block letter")
            if set(r.layers) != set(self.contract_layers):
                raise ConfigError(f"{r.role}: layers for {sorted(r.layers)}, flavors are {sorted(self.contract_layers)}")
        if len(self.separator) != 1 or re.fullmatch("[A-Za-z0-9-]", self.separator):
            raise ConfigError("the separator must be one character that ids do not use")
        if sorted(self.strictness) != sorted(self.statuses):
            raise ConfigError("strictness must order the statuses")
        if not set(self.invalidating) <= set(self.statuses):
            raise ConfigError("invalidating states must be statuses")
        for t in self.targets:
            if not set(t.scopes) <= set(self.scopes):
                raise ConfigError(f"target {t.id}: unknown scope")
        if {r.role for r in self.roles} != set(self.dependent_roles):
            raise ConfigError("callout roles and dependent roles differ")
        if lost := set(self.dependent_roles) - set(self.file_roles):
            raise ConfigError(f"no file can have the role {sorted(lost)}")
        if not set(self.required_fields) <= set(self.statuses):
            raise ConfigError("fields are required for unknown statuses")
        needed = {f for fs in self.required_fields.values() for f in fs}
        if odd := (set(self.enum_fields) | set(self.anchor_fields)) - needed:
            raise ConfigError(f"no status requires {sorted(odd)}")
        for what, level in (("unindexed default", self.unindexed_default), ("lifecycle", self.lifecycle_severity), ("naming", self.naming_severity), *self.unindexed.items()):
            if level not in LEVELS:
                raise ConfigError(f"{what}: level {level!r} is none of {LEVELS}")
        if odd := set(self.unindexed) - {p.id for p in self.partitions}:
            raise ConfigError(f"unindexed policy of unknown partitions {sorted(odd)}")
        if odd := {self.domain_sort, self.kind_sort} - set(SORTS):
            raise ConfigError(f"alternations are sorted by one of {SORTS}, not {sorted(odd)}")
        for g in self.ignore:
            glob_to_regex(g)
        for name in self.patterns:
            self.pattern(name)

    def pattern(self, name: str) -> str | None:
        """The configured pattern of a name, its parts filled in; None where the configuration has none."""
        if name not in self.patterns:
            return None
        parts = {
            "composite_id": self.composite_pattern,
            "anchor_id": self.id_pattern,
            "domain_alt": self.domain_alternation,
            "kind_alt": self.kind_alternation,
            "role_alt": alternation(self.document_roles),
            "file_role_alt": alternation(self.file_roles),
            "dependent_role_alt": alternation(self.dependent_roles),
            "subblock_letter_alt": alternation(self.subblocks, "as_declared"),
            "composite_sep": re.escape(self.separator),
            "locale_alt": "|".join(map(re.escape, self.locales)) if self.suffixed else "",
            "locale_sep": r"\." if self.suffixed else "",
            "extension_pattern": self.extension_pattern,
        }
        return expanded(name, self.patterns[name], parts)

    @property
    def extension_pattern(self) -> str:
        each = [re.escape(e) for e in sorted(self.extensions, key=len, reverse=True)]
        return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"

    # Patterns, in the dialect that Java and RE2 share.
    @property
    def domain_alternation(self) -> str:
        return alternation((p.domain for p in self.partitions), self.domain_sort)

    @property
    def kind_alternation(self) -> str:
        return alternation((r.token for r in self.roles), self.kind_sort)

    @property
    def id_pattern(self) -> str:
        return f"(?:{self.domain_alternation})(?:-[A-Za-z0-9]+)+"

    @property
    def composite_pattern(self) -> str:
        return f"(?:{self.id_pattern}){re.escape(self.separator)}(?:{alternation(r.role for r in self.roles)})-[A-Za-z0-9]+"

    @property
    def heading_pattern(self) -> str:
        return self.pattern("heading") or r"^(#{1,6})\s+(.*\S)\s*$"

    @property
    def anchor_pattern(self) -> str:
        return self.pattern("spec_anchor") or rf"^\^({self.id_pattern})\s*$"

    @property
    def callout_pattern(self) -> str:
        """Groups: token, target, title."""
        return self.pattern("ref_callout_start") or rf"^>\s*\[!({self.kind_alternation})-({self.composite_pattern}|{self.id_pattern})\]\s*(.*)$"

    @property
    def quote_pattern(self) -> str:
        """Group: what is quoted."""
        return self.pattern("blockquote_line") or r"^>\s?(.*)$"

    @property
    def title_pattern(self) -> str:
        """A level-one heading; group: its text."""
        return self.pattern("document_h1") or r"^#\s+(.*\S)\s*$"

    @property
    def fence_pattern(self) -> str:
        """What opens and closes front matter."""
        return self.pattern("frontmatter_fence") or r"^---\s*$"

    @property
    def status_pattern(self) -> str:
        return self.pattern("status_directive") or r"^\{status:\s*([A-Za-z][A-Za-z0-9_-]*)\s*\}$"

    @property
    def subblock_pattern(self) -> str:
        """What a sub-block's id ends with."""
        return self.pattern("subblock_suffix") or f"-(?:{alternation(self.subblocks, 'as_declared')})[0-9]+$"

    # What looks like an anchor, a callout, an admonition or a table, and may be none.
    @property
    def loose_anchor_pattern(self) -> str:
        return self.pattern("loose_anchor_line") or r"^\s*\^([A-Za-z0-9-]+)\s*$"

    @property
    def loose_callout_pattern(self) -> str:
        return self.pattern("loose_ref_line") or r"^\s*>\s*\[!([A-Za-z0-9-]+)\]"

    @property
    def admonition_pattern(self) -> str:
        return self.pattern("loose_admonition_open") or r"^(?:!!!|\?\?\?\+?)\s+\S.*$"

    @property
    def table_row_pattern(self) -> str:
        return self.pattern("loose_table_row") or r"^\s*\|.*\|\s*$"

    @property
    def parser_patterns(self) -> tuple:
        """All that blocks depend on: what a cache of them must be keyed by."""
        roles = tuple((r.role, r.token, r.letter) for r in self.roles)
        return (self.heading_pattern, self.anchor_pattern, self.callout_pattern, self.quote_pattern, self.status_pattern, self.separator, roles)

    @property
    def reference_pattern(self) -> str:
        return f"^(?:{self.composite_pattern}|{self.id_pattern})$"

    @property
    def file_pattern(self) -> str:
        """Groups of a base name: slug, role, locale (where suffixed), extension."""
        locale = rf"\.({alternation(self.locales)})" if self.suffixed else "()"
        return rf"^([^/]+?)(?:\.({alternation(self.document_roles)}))?{locale}({alternation(self.extensions)})$"

    @property
    def naming_pattern(self) -> str:
        locale = rf"\.({alternation(self.locales)})" if self.suffixed else "()"
        return self.pattern("file_naming") or rf"^([^.]+)(?:\.({alternation(self.file_roles)}))?{locale}(?:{alternation(self.extensions)})$"

    # Look-ups.
    def target(self, name: str) -> Target:
        for t in self.targets:
            if name in (t.id, *t.aliases):
                return t
        raise ConfigError(f"unknown target {name!r}")

    def emitted(self, target: str) -> list[str]:
        scopes = self.target(target).scopes
        return [p.id for p in self.partitions if p.scope in scopes]

    def restricted_prefixes(self, target: str) -> list[str]:
        scopes = self.target(target).scopes
        return [f"{self.root}/{s}/" for s in self.scopes if s not in scopes]

    def partition_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p.id, i, p.label, p.domain, p.codeowner, p.scope, p.flavor, p.path, p.default_role, p.pairs_with, self.scopes[p.scope]) for i, p in enumerate(self.partitions)]
        return spark.createDataFrame(rows, "id string, ord int, label string, domain string, codeowner string, scope string, flavor string, path string, default_role string, pairs_with string, level int")

    def role_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(r.role, i, r.token, r.graph_key, r.letter, r.layers) for i, r in enumerate(self.roles)]
        return spark.createDataFrame(rows, "role string, ord int, token string, graph_key string, letter string, layers map<string,string>")


def load(folder: str) -> Config:
    """A Config from taxonomy.yaml, corpus_layout.yaml, ui_projection.yaml and linter_rules.json, read in that order."""
    import yaml

    def read(name):
        text = (Path(folder) / name).read_text(encoding="utf-8")
        return json.loads(text) if name.endswith(".json") else yaml.safe_load(text)

    taxonomy, layout, projection, rules = (read(n) for n in ("taxonomy.yaml", "corpus_layout.yaml", "ui_projection.yaml", "linter_rules.json"))
    for name, found in (("taxonomy", taxonomy.get("config_version")), ("layout", layout.get("layout_version")), ("projection", projection.get("config_version")), ("rules", rules.get("config_version"))):
        if str(found) != CONFIG_VERSION:
            raise ConfigError(f"{name}: version {found!r}, not {CONFIG_VERSION}")
    root, own = layout.get("root", "docs"), layout.get("partitions") or {}
    where = {s["id"]: s.get("path") or "" for s in layout["scopes"]}

    def partition(p):
        extra = own.get(p["id"]) or {}
        path = extra.get("path") or "/".join(x for x in (root, where[p["scope"]], p["id"]) if x)
        return Partition(p["id"], p["label"], p["domain"], p["codeowner"], p["scope"], p["flavor"], path, extra.get("default_role"), extra.get("pairs_with"))

    kinds, shown = rules["callout_kinds"], projection["callout_kinds"]
    tokens = {role: token for token, role in kinds["aliases"].items()}
    if set(tokens) != set(shown) or set(tokens) != set(kinds["suffix_letters"]):
        raise ConfigError("the roles of aliases, letters and projection differ")
    locale = layout["filenames"].get("locale") or {}
    lifecycle, unindexed, naming = rules["dependent_lifecycle"], rules.get("unindexed_policy") or {}, rules["file_naming"]
    enums = {}
    for name, source in (lifecycle.get("enum_fields") or {}).items():
        if not lifecycle.get(source):
            raise ConfigError(f"{name}: no values under {source}")
        enums[name] = tuple(lifecycle[source])
    templates = {k: v for section in ("patterns", "diagnostic_patterns") for k, v in (rules.get(section) or {}).items() if k in CAPTURES}
    if naming.get("pattern"):
        templates["file_naming"] = naming["pattern"]
    return Config(
        partitions=tuple(partition(p) for p in taxonomy["partitions"]),
        scopes={s["id"]: s["level"] for s in layout["scopes"]},
        roles=tuple(Role(r, tokens[r], x["graph_key"], kinds["suffix_letters"][r], x["layer_by_flavor"]) for r, x in shown.items()),
        targets=tuple(Target(t["id"], tuple(t["scopes"]), t["artifact"], t.get("exposure", "public"), tuple(t.get("aliases", ()))) for t in layout["targets"]),
        contract_layers=projection["node_projection"]["contract"]["layer_by_flavor"],
        statuses=tuple(rules["status_values"]),
        strictness=tuple(lifecycle["strictness_order"]),
        invalidating=tuple(lifecycle["invalidating_parent_states"]),
        document_roles=tuple(rules["document_roles"]),
        file_roles=tuple(rules["file_naming"]["roles"]),
        locales=tuple(locale.get("values", ())),
        suffixed=locale.get("mode") == "suffix",
        extensions=tuple(layout["filenames"]["extensions"]),
        ignore=tuple(layout.get("ignore") or ()),
        root=root,
        staging=(layout.get("staging") or {}).get("root", "drafts"),
        separator=kinds["separator"],
        subblocks=tuple(kinds["subblock_letters"]),
        dependent_roles=tuple(lifecycle["dependent_roles"]),
        required_fields={k: tuple(v) for k, v in (lifecycle.get("conditional_requirements") or {}).items()},
        enum_fields=enums,
        anchor_fields=tuple(lifecycle.get("anchor_reference_fields") or ()),
        mutable_keys=tuple((rules.get("payload_lock") or {}).get("mutable_frontmatter_keys") or ()),
        unindexed=dict(unindexed.get("by_partition") or {}),
        unindexed_default=unindexed.get("default", "warn"),
        lifecycle_severity=lifecycle.get("severity", "fail"),
        naming_severity=naming.get("severity", "warn"),
        patterns=templates,
        lock_enforced=bool((rules.get("payload_lock") or {}).get("enforced", True)),
        domain_sort=rules.get("domain_alternation_sort", SORTS[0]),
        kind_sort=kinds.get("kind_alternation_sort", SORTS[0]),
    )
