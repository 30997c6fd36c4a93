"""DuckDB SQL of the catalogue's queries, written on its own from the same definitions."""

from __future__ import annotations

import re

# Fixed values of the definitions and of the queries, written out here once more: a wrong one in the code under test shows.
GENERATED_DIRS = "target node_modules dist build .next vendor __pycache__ .git".split()
GENERATED_SUFFIXES = "cargo.lock package-lock.json yarn.lock pnpm-lock.yaml poetry.lock pipfile.lock .min.js .min.css .map .bundle.js .pb.go .generated.ts .g.cs .designer.cs .lock".split()
SUFFIXES = (
    ('Rust', ('.rs',)),
    ('TypeScript', ('.ts', '.tsx', '.mts', '.cts')),
    ('JavaScript', ('.js', '.jsx', '.mjs', '.cjs')),
    ('Python', ('.py', '.pyi')),
    ('CSharp', ('.cs',)),
    ('Go', ('.go',)),
    ('Java', ('.java',)),
    ('C', ('.c', '.h')),
    ('Cpp', ('.cpp', '.cc', '.hpp', '.cxx')),
)
CALL_KEYWORDS = (
    "if else for while loop match return use mod fn struct enum impl trait const static let mut ref move where async await crate self Self super extern macro function class extends new typeof "
    "instanceof in of do switch case try catch finally throw def lambda import from with as assert sizeof true false print println"
).split()
EVIDENCE_PRIORITY = "secret-handling unsafe validation-removed untested-change blast-radius auth-surface symbol-removed schema".split()
STOPWORDS = (
    "a an the and or but of to in on for with by at from as is are was were be been it its this that these those should would could must need needs add adds added adding fix fixes fixed fixing "
    "update updates updated updating make makes use uses used using new also just please implement"
).split()
NOT_FUNCTIONS = "if else elif for foreach while do switch catch try finally throw return using lock fixed checked unchecked unless until".split()
JUDGE_LEVELS = ('Cosmetic, generated-adjacent, or test-only impact', 'Minor feature impact, easily reverted', 'Auth/security, data-loss, or migration impact')
RISKY_CATEGORIES = "Auth Security Schema Migration ApiBreak".split()
RISKY_SIGNALS = ('validation-removed', 'secret-handling', 'unsafe')
SIGNAL_ADDED = ('y', 'let password = ask();', 'run();', 'unsafe impl Send for X {}', 'let s = "unsafe impl none";', 'match x { }')
SIGNAL_CHANGES = "Added Removed Modified SignatureChanged VisibilityChanged Renamed Moved".split()
SIGNAL_DELETED = ('z', '// still valid', 'is_valid(z);', 'if z { }')
SIGNAL_PATHS = "web/signin/form.rs web/signins.rs tests/oauth_test.rs manual/login.md src/donkey.rs src/public_key.rs src/barn.rs db/prisma/rows.sql go.mod k8s/site.yaml yarn.lock lib/farm.rs".split()
NAMES = ('test_Region', 'should_REGION', 'regionTest', 'TestRegion', 'testregion', 'Region_test', 'Region', 'm::Region', 'a → b::Region', 'Test', 'contest')
DIRS = "src/auth tests docs migrations target deploy src/session lib".split()
EXTENSIONS = "rs py go ts js cs md".split()
KINDS = ('Function', 'Method', 'Const')
AUTH_WORDS = "auth session token password login oauth permission secret crypto signin sign-in".split()
SCHEMA_PARTS = ('migrat', 'schema', 'prisma/', 'alembic/')
MANIFESTS = "cargo.toml package.json pyproject.toml requirements.txt .csproj go.mod".split()
DEPLOY_PARTS = "dockerfile k8s/ deploy/ .github/workflows/ appsettings".split()
SECRET_PATH_WORDS = ('secret', 'credential', 'key')
SECRET_TEXT = ('secret', 'token', 'password')
SYMBOL_POINTS = {'Removed': 25, 'SignatureChanged': 22, 'VisibilityChanged': 20, 'Modified': 12, 'Added': 8, 'Renamed': 5, 'Moved': 5}
SYMBOL_FLOOR = {'Removed': 2, 'SignatureChanged': 1, 'VisibilityChanged': 1}
SYMBOL_CATEGORY = {'Removed': 'ApiBreak', 'SignatureChanged': 'Behavior', 'VisibilityChanged': 'ApiBreak', 'Modified': 'Behavior', 'Added': 'Behavior'}
SYMBOL_EVIDENCE = {
    'Removed': ('symbol-removed', 'symbol removed: '),
    'SignatureChanged': ('signature-changed', 'signature changed: '),
    'VisibilityChanged': ('visibility-changed', 'visibility changed: '),
    'Renamed': ('rename-move', 'renamed/moved: '),
    'Moved': ('rename-move', 'renamed/moved: '),
}
SYMBOL_CAP = 25
BASE_POINTS = 20
RISK_QUESTION = 'Does this change carry behavioral risk deserving human review?'
SEVERITY_QUESTION = 'How severe would a bug in this change be?'
RISK_CRITERIA = {'true': 'Logic change on a sensitive surface, or uncovered by tests', 'false': 'Mechanical, generated-adjacent, or fully covered change'}


# number of the language, then a row of each template of the catalogue's sources, by the line rules of its language
CODE_SYMBOLS = (
    (0, 1, "LIMIT", "Const", 1, 1, "LIMIT = …", False, True), (0, 2, "Box{k}", "Class", 3, 8, "class Box{k}", False, True), (0, 3, "Box{k}::open", "Method", 4, 5, "def open(…)", False, True),
    (0, 4, "Box{k}::_lid", "Method", 7, 8, "def _lid(…)", False, False), (0, 5, "test_box_{k}", "Test", 10, 11, "def test_box_{k}(…)", True, True),
    (1, 1, "Box{k}", "Struct", 1, 3, "struct Box{k}", False, True), (1, 2, "Box{k}::open", "Method", 6, 8, "fn open(& self) -> u64", False, True), (1, 3, "LIMIT", "Const", 11, 11, "const LIMIT", False, False),
    (1, 4, "opens_{k}", "Test", 14, 14, "fn opens_{k}()", True, False),
    (2, 1, "Box{k}", "Struct", 3, 5, "type Box{k} struct", False, True), (2, 2, "Load{k}", "Function", 7, 9, "func Load{k}(…)", False, True), (2, 3, "Box{k}::open", "Method", 11, 12, "func open(…)", False, False),
    (2, 4, "TestLoad{k}", "Test", 14, 14, "func TestLoad{k}(…)", True, True),
    (3, 1, "load{k}", "Function", 1, 1, "function load{k}(…)", False, True), (3, 2, "lid{k}", "Const", 2, 2, "const lid{k}", False, False), (3, 3, "Box{k}", "Class", 3, 5, "class Box{k}", False, True),
    (3, 4, "Box{k}::open", "Method", 4, 4, "open(…)", False, True), (3, 5, "Id{k}", "TypeAlias", 6, 6, "type Id{k}", False, True),
    (4, 1, "Box{k}", "Class", 1, 7, "class Box{k}", False, True), (4, 2, "Box{k}::_lid", "Field", 2, 2, "field _lid", False, False), (4, 3, "Box{k}::new", "Method", 3, 3, "Box{k}::new(…)", False, True),
    (4, 4, "Box{k}::Load", "Method", 4, 4, "Load(…)", False, True), (4, 5, "Box{k}::Loads", "Test", 5, 6, "Loads(…)", True, True),
)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def li(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def pick(xs, n: str) -> str:
    return f"({li(xs)})[({n}) % {len(xs)} + 1]"


def any_of(s: str, how: str, xs) -> str:
    return "(" + " OR ".join(f"{how}({s}, {q(x)})" for x in xs) + ")"


def lines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split_regex(regexp_replace({x}, '\r?\n$', ''), '\r?\n') END)"


def single(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}]+', ' ', 'g'))"


def split_ident(x: str) -> str:
    spaced = rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    spaced = rf"regexp_replace(regexp_replace({spaced}, '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')"
    return f"list_transform(list_filter(string_split({spaced}, ' '), w -> strlen(w) >= 2), w -> lower(w))"


def grams(x: str) -> str:
    return f"list_transform(range(1, greatest(length({x}) - 1, 1) + 1), k -> substr({x}, k, 2))"


def shared(a: str, b: str) -> str:
    """Multiset intersection of two lists of bigrams."""
    count = lambda xs: f"len(list_filter({xs}, y -> y = g))"
    return f"coalesce(list_sum(list_transform(list_distinct({a}), g -> least({count(a)}, {count(b)}))), 0)::INT"


def gram_count(x: str) -> str:
    return f"greatest(length({x}) - 1, 1)"


def possible(a: str, b: str) -> str:
    return f"(20 * least({gram_count(a)}, {gram_count(b)}) >= 6 * ({gram_count(a)} + {gram_count(b)}))"


def match(a: str, b: str, hits: str) -> str:
    total = f"({gram_count(a)} + {gram_count(b)})"
    inside = f"(contains({a}, {b}) OR contains({b}, {a})) AND strlen({a}) >= 4 AND strlen({b}) >= 4"
    return f"(CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {inside} THEN 0.8::DOUBLE WHEN NOT {possible(a, b)} THEN 0.0::DOUBLE WHEN 20 * {hits} >= 6 * {total} THEN 2.0::DOUBLE * {hits} / {total} ELSE 0.0::DOUBLE END)"


def strip_code(x: str) -> str:
    return rf"""regexp_replace({x}, '(?s)//.*$|"(?:\\.|[^"\\])*(?:"|\\?$)', '', 'g')"""


def language(p: str) -> str:
    whens = " ".join(f"WHEN {any_of(f'lower({p})', 'ends_with', xs)} THEN {q(name)}" for name, xs in SUFFIXES)
    return f"(CASE {whens} ELSE 'Unknown' END)"


def is_test_path(p: str) -> str:
    return rf"(list_has_any(string_split(lower({p}), '/'), ['test', 'tests']) OR regexp_matches(string_split(lower({p}), '/')[-1], '^(test_|test-)|_test\.|\.test\.|\.spec\.'))"


def by_name(p: str) -> str:
    return f"({any_of(f'lower({p})', 'ends_with', GENERATED_SUFFIXES)} OR list_has_any(string_split(lower({p}), '/'), {li(GENERATED_DIRS)}))"


def by_content(old: str, new: str) -> str:
    says = "contains(lower(l), 'auto-generated') OR contains(lower(l), 'autogenerated') OR contains(lower(l), '@generated') OR (contains(lower(l), 'do not edit') AND contains(lower(l), 'generat'))"
    one = lambda x: f"coalesce(len(list_filter({lines(x)}[1:5], l -> {says})) > 0, false)"
    return f"({one(old)} OR {one(new)})"


def parts(p: str) -> str:
    return f"string_split_regex(lower({p}), '[/._-]')"


def has_part(p: str, words) -> str:
    whole, inner = [w for w in words if "-" not in w], [w for w in words if "-" in w]
    return f"(list_has_any({parts(p)}, {li(whole)})" + (f" OR {any_of(f'lower({p})', 'contains', inner)}" if inner else "") + ")"


def formatting(lang: str, status: str, old: str, new: str) -> str:
    bare = lambda x: rf"regexp_replace({x}, '(?m)^[ \t]+', '', 'g')"
    plain = lambda x: rf"NOT regexp_matches({x}, '[\"''/\\]')"
    return f"coalesce({lang} = 'Rust' AND {status} = 'Modified' AND {old} <> {new} AND {plain(old)} AND {plain(new)} AND {bare(old)} = {bare(new)}, false)"


CHANGES = f"""
d0 AS (SELECT doc_id, text, lang, source, lag(text) OVER (PARTITION BY lang, source ORDER BY doc_id) AS old FROM documents),
ch AS (
  SELECT lang AS changeset_id, doc_id AS file_idx, {pick(DIRS, "doc_id")} || '/' || source || '/' || lang || '_' || doc_id || '.' || {pick(EXTENSIONS, "doc_id")} AS path,
         CASE WHEN old IS NULL THEN 'Added' ELSE 'Modified' END AS status, old AS old_content, text AS new_content
  FROM d0)"""
TALKS = """
t0 AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations),
ch AS (
  SELECT conv_id::VARCHAR AS changeset_id, turn AS file_idx, 'talk/' || conv_id || '/' || role || '.md' AS path, CASE WHEN old IS NULL THEN 'Added' ELSE 'Modified' END AS status,
         old AS old_content, text AS new_content
  FROM t0)"""
FILES = f"""
f0 AS (
  SELECT *, {language("path")} AS language, {is_test_path("path")} AS is_test_file, coalesce({lines("old_content")}, []) AS ol, coalesce({lines("new_content")}, []) AS nl
  FROM ch),
f1 AS (
  SELECT *, list_distinct(list_filter(nl, x -> NOT list_contains(ol, x))) AS added, list_distinct(list_filter(ol, x -> NOT list_contains(nl, x))) AS deleted,
         {by_name("path")} OR {by_content("old_content", "new_content")} AS is_generated
  FROM f0),
f AS (
  SELECT *, len(added)::BIGINT AS added_lines, len(deleted)::BIGINT AS deleted_lines,
         len(added) + len(deleted) > 0 AND {formatting("language", "status", "old_content", "new_content")} AS formatting_only
  FROM f1)"""


def scored(src: str) -> str:
    """CTEs s1..sc that score the rows of ``src``: priority, rank, severity, category, proof."""
    code = lambda c: f"array_to_string(list_transform({c}, x -> lower({strip_code('x')})), chr(10))"
    p = "lower(path)"
    branch = lambda c: f"(contains({c}, 'if ') OR contains({c}, 'match '))"
    unsafe = rf"len(list_filter(added, x -> regexp_matches(lower(trim({strip_code('x')})), '^unsafe|unsafe (fn|\{{|impl|trait|extern)'))) > 0 AND language = 'Rust'"
    points = "CASE s.change " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in SYMBOL_POINTS.items()) + " ELSE 0 END"
    floor = "CASE s.change " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in SYMBOL_FLOOR.items()) + " ELSE 0 END"
    category = "CASE s.change " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in SYMBOL_CATEGORY.items()) + " END"
    proof = "CASE s.change " + " ".join(f"WHEN {q(k)} THEN {q(v[0] + '=' + v[1])} || s.name" for k, v in SYMBOL_EVIDENCE.items()) + " END"
    say = lambda c, kind, what: f"CASE WHEN {c} THEN {q(kind + '=' + what)} END"
    before = ", ".join(
        [
            say("auth", "auth-surface", "change touches authentication/authorization surface"), say("sch", "schema", "database schema or migration change"), say("dep", "dependency-manifest", "dependency manifest changed"),
            say("cfg", "deploy-config", "deployment or runtime configuration changed"), say("is_test_file", "test-file", "test file — verifies behavior, rarely the risk itself"), say("docs", "docs", "documentation change"),
        ]
    )
    after = ", ".join(
        [
            say("uns", "unsafe", "new `unsafe` code"), say("val", "validation-removed", "deleted lines mention validation with no replacement"), say("cond", "conditional-changed", "branch conditions modified"),
            say("sec", "secret-handling", "secret/credential handling touched"),
        ]
    )
    return f"""
s0 AS (SELECT *, {code("added")} AS atext, {code("deleted")} AS dtext FROM {src}),
s1 AS (
  SELECT *, {has_part("path", AUTH_WORDS)} AS auth, {any_of(p, "contains", SCHEMA_PARTS)} OR ends_with({p}, '.sql') AS sch, {any_of(p, "ends_with", MANIFESTS)} AS dep,
         {any_of(p, "contains", DEPLOY_PARTS)} OR ends_with({p}, '.env') AS cfg, {any_of(p, "ends_with", (".md", ".rst"))} OR contains({p}, '/docs/') AS docs, {unsafe} AS uns,
         contains(dtext, 'valid') AND NOT contains(atext, 'valid') AS val, {branch("dtext")} AND {branch("atext")} AS cond,
         {has_part("path", SECRET_PATH_WORDS)} AND {any_of("atext", "contains", SECRET_TEXT)} AS sec,
         least(coalesce(list_sum(list_transform(symbols, s -> {points})), 0), {SYMBOL_CAP}) AS bonus, coalesce(list_max(list_transform(symbols, s -> {floor})), 0) AS sfloor,
         list_filter(list_transform(symbols, s -> {category}), c -> c IS NOT NULL)[1] AS scat, list_filter(list_transform(symbols, s -> {proof}), c -> c IS NOT NULL) AS sproof
  FROM s0),
s2 AS (
  SELECT *, greatest(0, least(100, {BASE_POINTS} + bonus + 45 * auth::INT + 40 * sch::INT + 30 * dep::INT + 25 * cfg::INT - 10 * is_test_file::INT - 12 * docs::INT
           + 20 * uns::INT + 18 * val::INT + 10 * cond::INT + 25 * sec::INT))::INT AS pr,
         greatest(sfloor, 2 * auth::INT, 2 * sch::INT, dep::INT, cfg::INT, 2 * uns::INT, 2 * val::INT, 3 * sec::INT) AS fl
  FROM s1),
sc AS (
  SELECT * EXCLUDE (pr, fl), CASE WHEN is_generated THEN 2 WHEN formatting_only THEN 3 ELSE pr END::INT AS priority,
         CASE WHEN is_generated OR formatting_only THEN 0 ELSE greatest(fl, CASE WHEN pr >= 80 THEN 3 WHEN pr >= 55 THEN 1 ELSE 0 END) END::INT AS severity_rank,
         CASE WHEN is_generated OR formatting_only THEN 'Mechanical' WHEN sec THEN 'Security' WHEN docs THEN 'Docs' WHEN is_test_file THEN 'Test' WHEN auth THEN 'Auth' WHEN sch THEN 'Schema'
              WHEN dep THEN 'Dependency' WHEN cfg THEN 'Config' WHEN scat IS NOT NULL THEN scat WHEN uns OR val THEN 'Security' WHEN pr >= 55 THEN 'Behavior' ELSE 'Refactor' END AS category,
         CASE WHEN is_generated THEN ['generated=generated or lockfile output — collapsed by default'] WHEN formatting_only THEN ['formatting-only=whitespace/punctuation-only diff']
              ELSE list_filter(list_concat([{before}], sproof, [{after}]), c -> c IS NOT NULL) END AS proofs
  FROM s2)"""


SEVERITY = "(['Low', 'Medium', 'High', 'Critical'])[severity_rank + 1]"
ITEMS = f"""
fs AS (SELECT *, []::STRUCT(name VARCHAR, change VARCHAR)[] AS symbols FROM f),
{scored("fs")},
mech AS (
  SELECT changeset_id, 'mechanical' AS id, 'Generated / mechanical changes — ' || count(*) || ' file' || CASE WHEN count(*) = 1 THEN '' ELSE 's' END || ' collapsed' AS title, 'Mechanical' AS category,
         'Low' AS severity, 0 AS severity_rank, 2 AS priority, 0.9 AS confidence, list(path ORDER BY file_idx, path) AS files,
         ['mechanical-bucket=' || sum(added_lines + deleted_lines)::BIGINT || ' changed lines across generated/formatting-only files'] AS proofs,
         'These files match generated-output or whitespace-only heuristics. Expand to verify, but they rarely need line-by-line review.' AS why
  FROM f WHERE is_generated OR formatting_only GROUP BY changeset_id),
items AS (
  SELECT changeset_id, 'file:' || path AS id, CASE WHEN status = 'Added' THEN path || ' — new file' ELSE path || ' — +' || added_lines || ' −' || deleted_lines END AS title, category,
         {SEVERITY} AS severity, severity_rank, priority, 0.8 AS confidence, [path] AS files, proofs, 'No parseable symbols changed in this file (' || path || '). Review the raw diff.' AS why
  FROM sc WHERE NOT (is_generated OR formatting_only) AND added_lines + deleted_lines > 0
  UNION ALL SELECT * FROM mech),
ranked AS (SELECT *, row_number() OVER (PARTITION BY changeset_id ORDER BY severity_rank DESC, priority DESC, title, id)::INT AS pos FROM items)"""
DOC_ITEMS = f"WITH {CHANGES}, {FILES}, {ITEMS}"


def line_symbols(where: str = "true") -> str:
    """CTE ls: a symbol for each line with an identifier, of both sides of ch."""
    side = lambda s, c: f"SELECT changeset_id, path AS file, '{s}' AS side, unnest({lines(c)}) AS line, generate_subscripts({lines(c)}, 1) AS n FROM ch WHERE {c} IS NOT NULL AND {where}"
    return rf"""
l0 AS ({side("old", "old_content")} UNION ALL {side("new", "new_content")}),
l1 AS (SELECT *, regexp_extract(line, '([\p{{L}}\p{{N}}_]+)', 1) AS name FROM l0),
ls AS (
  SELECT changeset_id, file, side, n::INT AS sym_idx, name, {pick(KINDS, "length(name)")} AS kind, n::INT AS start_line, n::INT AS end_line, string_split(line, '.')[1] AS signature,
         length(line) % 5 <> 0 AS is_public, line AS body
  FROM l1 WHERE name <> '')"""


PAIRS = """
r0 AS (SELECT *, row_number() OVER (PARTITION BY changeset_id, file, kind, name, side ORDER BY sym_idx, signature, body) AS rn FROM ls),
o AS (SELECT * FROM r0 WHERE side = 'old'), n AS (SELECT * FROM r0 WHERE side = 'new'),
pr AS (
  SELECT changeset_id, file, kind, name, rn, o.signature AS old_signature, n.signature AS new_signature, o.start_line AS old_start, n.start_line AS new_start, o.is_public AS op, n.is_public AS np,
         o.body AS ob, n.body AS nb
  FROM o FULL OUTER JOIN n USING (changeset_id, file, kind, name, rn))"""
DIFF = f"""{PAIRS},
sd AS (
  SELECT *, 'SignatureChanged' AS change, 0.95 AS confidence, 'signature: ''' || old_signature || ''' → ''' || new_signature || '''' AS proof FROM pr WHERE old_signature <> new_signature
  UNION ALL SELECT *, 'Modified', 0.9, 'body lines differ' FROM pr WHERE old_signature = new_signature AND ob <> nb AND ob <> '' AND nb <> ''
  UNION ALL SELECT *, 'VisibilityChanged', 0.95, 'visibility flag changed' FROM pr WHERE op <> np
  UNION ALL SELECT *, 'Added', 0.98, 'no matching symbol in base version' FROM pr WHERE old_start IS NULL
  UNION ALL SELECT *, 'Removed', 0.95, 'symbol absent from new version' FROM pr WHERE new_start IS NULL)"""
TALK_DIFF = f"WITH {TALKS}, {line_symbols()}, {DIFF}"
CHANGE_COLUMNS = "changeset_id, file, name, kind, change, old_signature, new_signature, old_start, new_start"
LONE = """
lone AS (
  SELECT changeset_id, file, kind, name, CASE WHEN old_start IS NULL THEN 'Added' ELSE 'Removed' END AS change, old_start, new_start, coalesce(ob, nb) AS body FROM pr
  WHERE old_start IS NULL OR new_start IS NULL)"""


def unique_moves(key: str) -> str:
    """CTE mv: pairs of one removed and one added symbol with the same key."""
    one = lambda c, x: f"max(CASE WHEN change = '{c}' THEN {x} END)"
    return rf"""
ky AS (SELECT *, {key} AS k FROM lone),
gp AS (
  SELECT changeset_id, kind, k, count(*) FILTER (change = 'Removed') AS nr, count(*) FILTER (change = 'Added') AS na, {one("Removed", "file")} AS rf, {one("Added", "file")} AS af,
         {one("Removed", "name")} AS rname, {one("Added", "name")} AS aname, {one("Removed", "old_start")} AS old_start, {one("Added", "new_start")} AS new_start
  FROM ky WHERE k <> '' GROUP BY ALL),
mv AS (
  SELECT changeset_id, af AS file, CASE WHEN rname = aname AND rf <> af THEN aname ELSE rname || ' → ' || aname END AS name, kind, CASE WHEN rf = af THEN 'Renamed' ELSE 'Moved' END AS change,
         CASE WHEN rf <> af THEN rf END AS moved_from, old_start, new_start, CASE WHEN rf = af THEN 0.85 WHEN rname = aname THEN 0.95 ELSE 0.7 END AS confidence,
         CASE WHEN rf = af THEN 'identical body, different name — treated as rename' WHEN rname = aname THEN 'moved-from:' || rf || '|body identical — pure relocation'
              ELSE 'moved-from:' || rf || '|renamed ' || rname || ' → ' || aname || ' in the move' END AS proof
  FROM gp WHERE nr = 1 AND na = 1)"""


# Each new symbol in turn takes the best old one left: a step of the recursion is one turn of every file and kind.
GREEDY = f"""WITH RECURSIVE {TALKS}, {line_symbols()}, {PAIRS},
lo AS (SELECT *, row_number() OVER (PARTITION BY changeset_id, file, kind ORDER BY name, rn) AS oi FROM pr WHERE new_start IS NULL),
ln AS (SELECT *, row_number() OVER (PARTITION BY changeset_id, file, kind ORDER BY name, rn) AS ni FROM pr WHERE old_start IS NULL),
cd AS (
  SELECT changeset_id, file, kind, oi, ni, 2 * {shared(grams("a"), grams("b"))} AS hits, {gram_count("a")} + {gram_count("b")} AS total
  FROM (SELECT lo.changeset_id, lo.file, lo.kind, oi, ni, lower(lo.name) AS a, lower(ln.name) AS b FROM lo JOIN ln USING (changeset_id, file, kind))),
ok AS MATERIALIZED (SELECT *, round(hits / total * 1e9)::HUGEINT * 1000000 - oi AS score FROM cd WHERE 10 * hits > 6 * total),
ng AS MATERIALIZED (SELECT changeset_id, file, kind, max(ni) AS turns FROM ok GROUP BY ALL),
g AS (
  SELECT changeset_id, file, kind, 0::BIGINT AS turn, []::BIGINT[] AS used, NULL::BIGINT AS best FROM ng
  UNION ALL
  SELECT changeset_id, file, kind, turn + 1, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best
  FROM (SELECT g.changeset_id, g.file, g.kind, g.turn, g.used, arg_max(ok.oi, ok.score) FILTER (NOT list_contains(g.used, ok.oi)) AS best
        FROM g JOIN ng ON ng.changeset_id = g.changeset_id AND ng.file = g.file AND ng.kind = g.kind AND g.turn < ng.turns
        LEFT JOIN ok ON ok.changeset_id = g.changeset_id AND ok.file = g.file AND ok.kind = g.kind AND ok.ni = g.turn + 1
        GROUP BY ALL)),
m AS (SELECT changeset_id, file, kind, turn AS ni, best AS oi FROM g WHERE best IS NOT NULL)
SELECT changeset_id, file, lo.name || ' → ' || ln.name AS name, kind, 'Renamed' AS change, lo.old_signature, ln.new_signature, lo.old_start, ln.new_start
FROM m JOIN lo USING (changeset_id, file, kind, oi) JOIN ln USING (changeset_id, file, kind, ni)
UNION ALL SELECT changeset_id, file, name, kind, 'Removed', old_signature, NULL, old_start, NULL FROM lo ANTI JOIN m USING (changeset_id, file, kind, oi)
UNION ALL SELECT changeset_id, file, name, kind, 'Added', NULL, new_signature, NULL, new_start FROM ln ANTI JOIN m USING (changeset_id, file, kind, ni)"""


NO_SPACE = r"[\s\x{85}\x{A0}\x{2028}\x{2029}]+"
BODY_KEY = rf"regexp_replace(body, '{NO_SPACE}', '', 'g')"
NOSIG_KEY = rf"regexp_replace(regexp_replace(body, '^[^\n]*\n?', ''), '{NO_SPACE}', '', 'g')"
EXACT = f"WITH {CHANGES}, {line_symbols()}, {PAIRS}, {LONE}, {unique_moves(BODY_KEY)}"


def check() -> str:
    """CTE vd: each benchmark text as a task against the words of all documents, by every pair of lengths that may match."""
    inside = "(contains(term, token) OR contains(token, term)) AND strlen(term) >= 4 AND strlen(token) >= 4"
    return f"""
WITH v0 AS (SELECT doc_id, unnest({split_ident("text")}) AS token FROM documents),
voc AS (SELECT token, min(doc_id) AS ord FROM v0 GROUP BY token),
tt AS (SELECT item_id AS task_id, list_filter({split_ident("text")}, w -> strlen(w) >= 3 AND NOT list_contains({li(STOPWORDS)}, w)) AS ws FROM benchmark),
te AS (SELECT task_id, unnest(ws) AS term, generate_subscripts(ws, 1) AS idx FROM tt),
tm AS (SELECT task_id, term, min(idx) AS idx FROM te GROUP BY ALL),
dt AS (SELECT DISTINCT term FROM tm),
ms AS (SELECT term FROM dt WHERE term NOT IN (SELECT token FROM voc)),
mg AS (SELECT DISTINCT term, unnest({grams("term")}) AS g FROM ms),
vg AS (SELECT DISTINCT token, ord, unnest({grams("token")}) AS g FROM voc),
pr AS (SELECT DISTINCT term, token, ord FROM mg JOIN vg USING (g) WHERE {possible("term", "token")} OR ({inside})),
px AS (SELECT *, CASE WHEN {possible("term", "token")} THEN {shared(grams("term"), grams("token"))} ELSE 0 END AS hits FROM pr),
sc AS (SELECT *, {match("term", "token", "hits")} AS score FROM px),
fz AS (SELECT term, arg_min(ord, {{'s': -score, 'o': ord, 't': token}}) AS ord FROM sc WHERE score > 0 GROUP BY term),
ok AS (SELECT term, ord FROM dt JOIN voc ON voc.token = dt.term UNION ALL SELECT term, ord FROM fz),
tc AS (
  SELECT b.item_id AS task_id, count(t.term) AS terms, count(k.term) AS matched, coalesce(string_agg(CASE WHEN k.term IS NOT NULL THEN t.term || '=doc ' || k.ord END, '|' ORDER BY t.idx), '') AS via,
         coalesce(string_agg(CASE WHEN k.term IS NULL THEN t.term END, '|' ORDER BY t.idx), '') AS unmatched
  FROM benchmark b LEFT JOIN tm t ON t.task_id = b.item_id LEFT JOIN ok k ON k.term = t.term GROUP BY b.item_id),
vd AS (SELECT *, CASE WHEN terms > 0 AND 10 * matched >= 8 * terms THEN 'Covered' WHEN terms > 0 AND 3 * matched >= terms THEN 'Partial' ELSE 'Uncovered' END AS verdict FROM tc)"""


def _cores(x: str) -> str:
    found = ", ".join([x, *[f"regexp_extract({x}, '{p}', 1)" for p in ("^test_(.*)$", "^should_(.*)$", "^(.*)_test$", "^[tT]est([A-Z].*)$", "^(.+)Test$")]])
    return f"list_distinct(list_transform(list_filter([{found}], c -> c <> ''), c -> lower(c)))"


LITERALS = ["x = 1;", 'let s = "a // b";', "call(); // note", 'say("he said \\"no\\"") + 2', "http://host/path", 'open("never closed', "plain"]
PAGE_PATH = r"regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g')"
CALLS = rf"""list_filter(list_distinct(regexp_extract_all(regexp_replace(html, '(?s)"(?:\\.|[^"\\])*(?:"|\\?\z)|//[^\n]*', chr(1), 'g'), '([\p{{L}}_][\p{{L}}\p{{N}}_]*)\(', 1)), c -> NOT list_contains({li([*CALL_KEYWORDS, "_"])}, c))"""
IDENTS = r"[\p{L}\p{N}_]+"
SUMMARY = "'referenced by ' || len(a) || ' file' || CASE WHEN len(a) = 1 THEN '' ELSE 's' END || ': ' || array_to_string(a[1:8], ', ') || CASE WHEN len(a) > 8 THEN ' (and ' || (len(a) - 8) || ' more)' ELSE '' END"


def github(x: str) -> str:
    return f"replace({single(x)}, '%', '%25')"


def xml(x: str) -> str:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        x = f"replace({x}, '{raw}', '{safe}')"
    return x


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}
    sql["review_summary"] = f"{DOC_ITEMS} SELECT changeset_id, pos AS item_rank, id, category, severity, priority FROM ranked"
    path = "p_name || " + pick((".rs", ".TSX", ".mjs", ".pyi", ".cs", ".go", ".java", ".h", ".cxx", ".txt", ""), "p_partkey")
    sql["language_from_path"] = f"WITH p AS (SELECT p_partkey, {path} AS path FROM part) SELECT p_partkey, {language('path')} AS language, {language('path')} <> 'Unknown' AS supported FROM p"
    sql["path_flags"] = f"WITH {CHANGES}, {FILES} SELECT path, language, is_test_file, {by_name('path')} AS by_name, {by_content('old_content', 'new_content')} AS by_content, array_to_string({parts('path')}, '|') AS parts FROM f"
    sql["file_records"] = f"""WITH {CHANGES}, {FILES} SELECT file_idx, status, added_lines, deleted_lines, formatting_only,
        is_generated OR coalesce(strlen(old_content) > 524288, false) OR coalesce(strlen(new_content) > 524288, false) AS skip, CASE WHEN file_idx % 3 = 0 THEN 'old/name' ELSE path END AS shown,
        {pick(("Added", "Deleted", "Modified", "Renamed", "Copied", "TypeChanged", "Untracked", "Modified"), "file_idx")} AS status_of FROM f"""
    body = pick(("run();", 'let x = "q";', "a / b", "go()"), "l_linenumber")
    sql["formatting_only"] = rf"""WITH a AS (SELECT l_orderkey, l_linenumber, 'fn a() {{' || chr(10) || '    ' || {body} || chr(10) || '}}' AS old FROM lineitem),
        b AS (SELECT *, CASE WHEN l_orderkey % 2 = 0 THEN regexp_replace(old, '(?m)^    ', chr(9) || chr(9), 'g') ELSE replace(old, '(', ' (') END AS new,
              CASE WHEN l_orderkey % 5 = 0 THEN 'Go' ELSE 'Rust' END AS lang, CASE WHEN l_linenumber = 7 THEN 'Added' ELSE 'Modified' END AS status FROM a)
        SELECT l_linenumber, {formatting("lang", "status", "old", "new")} AS formatting_only, count(*) AS n FROM b GROUP BY ALL"""
    sql["split_ident_counts"] = f"WITH t AS (SELECT unnest({split_ident('text')}) AS token FROM documents) SELECT token, count(*) AS n FROM t GROUP BY token"
    terms = f"list_filter({split_ident('text')}, w -> strlen(w) >= 3 AND NOT list_contains({li(STOPWORDS)}, w))"
    sql["task_terms"] = f"""WITH t AS (SELECT item_id, unnest({terms}) AS w, generate_subscripts({terms}, 1) AS i FROM benchmark), u AS (SELECT item_id, w, min(i) AS i FROM t GROUP BY ALL)
        SELECT b.item_id, coalesce(string_agg(w, '|' ORDER BY i), '') AS terms FROM benchmark b LEFT JOIN u USING (item_id) GROUP BY b.item_id"""
    sql["bigram_dice_parts"] = f"""WITH p AS (SELECT p_partkey, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
        h AS (SELECT *, {shared(grams("a"), grams("b"))} AS shared FROM p WHERE b IS NOT NULL)
        SELECT p_partkey, shared, round(2.0 * shared / ({gram_count("a")} + {gram_count("b")}), 6) AS dice, {possible("a", "b")} AS possible, round({match("a", "b", "shared")}, 6) AS score FROM h"""
    sql["name_similarity_customers"] = f"""WITH p AS (SELECT c_custkey, lower(c_name) AS a, lower(lead(c_name) OVER (PARTITION BY c_nationkey ORDER BY c_custkey)) AS b FROM customer)
        SELECT c_custkey, round(2.0 * {shared(grams("a"), grams("b"))} / ({gram_count("a")} + {gram_count("b")}), 6) AS similarity FROM p WHERE b IS NOT NULL"""
    sql["called_names_pages"] = f"SELECT page_id, array_to_string(list_sort({CALLS}), '|') AS calls FROM pages"
    sql["ident_list_pages"] = f"SELECT page_id, len(regexp_extract_all(html, '{IDENTS}'))::INT AS n, md5(array_to_string(regexp_extract_all(url, '{IDENTS}'), '|')) AS of_url FROM pages"
    sql["content_key_documents"] = "SELECT doc_id, sha256(encode(lang) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS content_key FROM documents"
    line = f"{pick(LITERALS, 'p_partkey')} || ' ' || {pick(LITERALS, '(p_partkey // 7)')}"
    sql["strip_literals_values"] = f"""WITH p AS (SELECT p_partkey AS ps, {line} AS line FROM part) SELECT ps, {strip_code("line")} AS stripped,
        CASE WHEN NOT contains(line, '"') AND NOT contains(line, '//') THEN line ELSE {strip_code("line")} END AS cleaned FROM p"""
    sql["escapes"] = f"""WITH c AS (SELECT conv_id, turn, text AS t FROM conversations)
        SELECT conv_id, turn, {github("t")} AS github, replace(replace({github("t")}, ':', '%3A'), ',', '%2C') AS prop, {xml("t")} AS xml, '''' || replace(t, '''', '''\\''''') || '''' AS shell FROM c"""
    sql["truncate_tokens"] = f"SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '…' ELSE text END AS head, ceil(length(text) / 4)::INT AS tokens, md5({single('text')}) AS line, md5(regexp_replace(text, '^{NO_SPACE}|{NO_SPACE}$', '', 'g')) AS trimmed FROM documents"
    sql["text_lines"] = rf"""WITH l AS (SELECT doc_id, {lines("text")} AS l FROM documents), b AS (SELECT doc_id, l, CASE WHEN len(l) >= 2 THEN array_to_string(l[2:4], chr(10)) END AS body FROM l)
        SELECT doc_id, len(l)::INT AS n, md5(coalesce(body, '-')) AS body, md5(coalesce({BODY_KEY}, '-')) AS body_key, md5(coalesce({NOSIG_KEY}, '-')) AS nosig_key FROM b"""
    short = "string_split(string_split(name, ' → ')[-1], '::')[-1]"
    sql["name_functions"] = f"""WITH n AS (SELECT n_nationkey, unnest({li(NAMES)}) AS name FROM nation) SELECT n_nationkey, name, array_to_string(list_sort({_cores("name")}), '|') AS cores,
        list_contains({_cores("name")}, 'region') AS targets, {short} AS short, regexp_matches(name, 'Test|Fact|Theory') AS attr FROM n"""
    severity = pick(("Low", "Medium", "Medium", "High", "Critical", "Critical"), "n_nationkey")
    verdict = pick(("Covered", "Covered", "Partial", "Uncovered", "Uncovered", "Covered"), "n_nationkey")
    kind = pick(("unsafe", "schema", "docs", "secret-handling", "blast-radius", "x"), "n_nationkey")
    sql["level_names"] = f"""SELECT n_nationkey, {severity} AS severity, (list_position(['Low', 'Medium', 'High', 'Critical'], {severity}) - 1)::INT AS severity_rank, {verdict} AS verdict, {verdict} <> 'Covered' AS trips,
        coalesce(list_position({li(EVIDENCE_PRIORITY)}, {kind}) - 1, {len(EVIDENCE_PRIORITY)})::INT AS evidence_rank FROM nation"""
    sql["generic_symbols_documents"] = rf"""WITH s AS (
          SELECT 'doc/' || doc_id AS file, text AS content FROM documents
          UNION ALL SELECT 'page/' || page_id, 'def run(' || page_id || '):' || chr(10) || 'class Page' || page_id || ':' || chr(10) || 'public void load(int x) {{' || chr(10) || 'if (x) {{' || chr(10)
                 || '  async def test_go():' || chr(10) || '// def no():' || chr(10) || html FROM pages),
        l AS (SELECT file, unnest({lines("content")}) AS line, generate_subscripts({lines("content")}, 1)::INT AS n FROM s),
        w AS (SELECT file, n, regexp_replace(line, '^{NO_SPACE}|{NO_SPACE}$', '', 'g') AS whole FROM l),
        t AS (SELECT *, regexp_replace(whole, '^async ', '') AS t FROM w WHERE whole <> '' AND NOT regexp_matches(whole, '^(//|#|\*)')),
        c AS (SELECT *, nullif(trim(regexp_extract(t, '^def ([^(:]*)', 1)), '') AS d, nullif(regexp_extract(t, '^class ([^(:\s]*)', 1), '') AS c,
              trim(regexp_extract(trim(regexp_extract(t, '^([^(]*)\(', 1)), '(\S*)$', 1), '*&') AS f0 FROM t),
        f AS (SELECT *, CASE WHEN contains(t, '(') AND contains(t, ')') AND regexp_matches(t, 'public |private |func |void |\{{$') AND regexp_full_match(f0, '{IDENTS}') AND NOT list_contains({li(NOT_FUNCTIONS)}, f0) THEN f0 END AS f FROM c),
        x AS (SELECT *, coalesce(d, c, f) AS name FROM f)
        SELECT file, name, CASE WHEN d IS NOT NULL AND starts_with(d, 'test_') THEN 'Test' WHEN d IS NULL AND c IS NOT NULL THEN 'Class' ELSE 'Function' END AS kind, n AS start_line,
               CASE WHEN d IS NOT NULL THEN 'def ' || d || '(…)' WHEN c IS NOT NULL THEN 'class ' || c ELSE t END AS signature,
               CASE WHEN d IS NOT NULL THEN starts_with(d, 'test_') ELSE contains(name, 'test') OR contains(whole, '[Test') OR contains(whole, '@Test') END AS is_test,
               CASE WHEN d IS NOT NULL THEN NOT starts_with(d, '_') ELSE contains(whole, 'pub ') OR contains(whole, 'public ') END AS is_public
        FROM x WHERE name IS NOT NULL"""
    sql["symbol_diff_lines"] = f"{TALK_DIFF} SELECT {CHANGE_COLUMNS}, confidence::DOUBLE AS confidence, proof FROM sd"
    sql["symbol_added_removed"] = f"{TALK_DIFF} SELECT changeset_id, change, count(*) AS n FROM sd WHERE change IN ('Added', 'Removed') GROUP BY ALL"
    sql["visibility_pairs"] = f"{TALK_DIFF} SELECT changeset_id, file, name, kind, old_start, new_start FROM sd WHERE change = 'VisibilityChanged'"
    move_columns = "changeset_id, file, name, kind, change, moved_from, old_start, new_start"
    sql["exact_moves"] = f"{EXACT} SELECT {move_columns}, confidence::DOUBLE AS confidence, proof FROM mv"
    doc = lambda s, c: f"SELECT changeset_id, path AS file, '{s}' AS side, '{s}' || file_idx AS name, 'Function' AS kind, {c} AS body FROM ch WHERE {c} IS NOT NULL"
    # one-line bodies are alike in four of five lines only if they are equal
    sql["similar_moves"] = f"""WITH {CHANGES}, {line_symbols()}, {PAIRS}, {LONE}, {unique_moves("name")}, bd AS (
        SELECT changeset_id, kind, name AS aname, max(CASE WHEN change = 'Removed' THEN body END) AS rb, max(CASE WHEN change = 'Added' THEN body END) AS ab FROM lone GROUP BY ALL)
        SELECT changeset_id, file, name, kind, 'Moved' AS change, moved_from, old_start, new_start FROM mv JOIN bd ON bd.changeset_id = mv.changeset_id AND bd.kind = mv.kind AND bd.aname = mv.name
        WHERE moved_from IS NOT NULL AND rb = ab AND strlen(rb) + strlen(ab) <= 131072""".replace("SELECT changeset_id, file, name, kind, 'Moved'", "SELECT mv.changeset_id, mv.file, mv.name, mv.kind, 'Moved'")
    sql["greedy_renames"] = GREEDY
    sql["nosig_moves"] = f"""WITH {CHANGES}, lone AS (SELECT *, CASE WHEN side = 'old' THEN 'Removed' ELSE 'Added' END AS change, CASE WHEN side = 'old' THEN 1 END AS old_start, CASE WHEN side = 'new' THEN 1 END AS new_start
        FROM ({doc("old", "old_content")} UNION ALL {doc("new", "new_content")})), {unique_moves(NOSIG_KEY)} SELECT {move_columns} FROM mv"""
    sql["reorder_moves"] = rf"""WITH b AS (SELECT 'doc/' || doc_id AS file, regexp_extract_all(text, '{IDENTS}') AS w FROM documents),
        o AS (SELECT file, unnest(w) AS name, generate_subscripts(w, 1) AS i FROM b), n AS (SELECT file, unnest(list_sort(w)) AS name, generate_subscripts(w, 1) AS i FROM b),
        o2 AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY i) AS rn FROM o), n2 AS (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY i) AS rn FROM n)
        SELECT file, name, (o2.i - 1)::INT AS old_start, (n2.i - 1)::INT AS new_start, 'reordered within ' || file || ': position ' || o2.i || ' → ' || n2.i AS proof
        FROM o2 JOIN n2 USING (file, name, rn) WHERE o2.i <> n2.i"""
    proof = "array_to_string(proofs, '|') AS proof"
    sql["file_scores"] = f"{DOC_ITEMS} SELECT path, priority, {SEVERITY} AS severity, category, {proof} FROM sc"
    sig = f"""g AS (SELECT o_orderkey AS file_idx, {pick(SIGNAL_PATHS, "o_orderkey")} AS path, [{pick(SIGNAL_ADDED, "o_orderkey // 12")}] AS added, [{pick(SIGNAL_DELETED, "o_orderkey // 72")}] AS deleted,
        [{{'name': 'f', 'change': {pick(SIGNAL_CHANGES, "o_orderkey")}}}, {{'name': 'g', 'change': {pick(SIGNAL_CHANGES, "o_orderkey // 7")}}}][1:o_orderkey % 3] AS symbols FROM orders),
        gs AS (SELECT *, {language("path")} AS language, {by_name("path")} AS is_generated, false AS formatting_only, {is_test_path("path")} AS is_test_file FROM g)"""
    sql["signal_scores"] = f"WITH {sig}, {scored('gs')} SELECT file_idx, priority, {SEVERITY} AS severity, category, {proof} FROM sc"
    weight = "CASE change " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in SYMBOL_POINTS.items()) + " END"
    sql["symbol_bonus"] = f"{TALK_DIFF} SELECT changeset_id, file, least(sum({weight}), {SYMBOL_CAP})::INT AS bonus FROM sd GROUP BY ALL"
    sql["mechanical_bucket"] = f"{DOC_ITEMS} SELECT changeset_id, title, len(files)::INT AS n, md5(array_to_string(files, '|')) AS files, {proof} FROM mech"
    sql["gate_top"] = f"""{DOC_ITEMS}, g AS (SELECT *, row_number() OVER (PARTITION BY changeset_id ORDER BY severity_rank DESC, priority DESC, title DESC, id DESC) AS r FROM items
        WHERE category <> 'Mechanical' AND severity_rank >= 1) SELECT changeset_id, id, title, severity, priority FROM g WHERE r = 1"""
    judged = """jd AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY changeset_id ORDER BY severity_rank DESC, priority DESC, id)::INT AS pos FROM ranked WHERE category <> 'Mechanical')"""
    sql["judged_top25"] = f"{DOC_ITEMS}, {judged} SELECT changeset_id, pos, id FROM jd WHERE pos <= 25"
    signals = " + ".join(f"10 * (len(list_filter(proofs, p -> starts_with(p, '{k}='))) > 0)::INT" for k in RISKY_SIGNALS)
    sql["deterministic_judge"] = f"""{DOC_ITEMS}, {judged} SELECT changeset_id, id, least(15 + 25 * list_contains({li(RISKY_CATEGORIES)}, category)::INT + {signals}, 95) / 100 AS risk,
        least(severity_rank, 2)::DOUBLE AS score, ({li(JUDGE_LEVELS)})[least(severity_rank, 2) + 1] AS level FROM jd WHERE pos <= 25"""
    sql["judge_answers"] = f"""{DOC_ITEMS}, a AS (SELECT c.changeset_id, 'file:' || c.path AS id, doc_id AS k FROM labels JOIN ch c ON c.file_idx = doc_id)
        SELECT changeset_id, id, CASE WHEN k % 2 = 0 THEN 'judge-risk=Judge P(risky)=' || printf('%.2f', (k % 10) / 10) ELSE 'judge-severity=Judge severity ' || printf('%.1f', (k % 4)::DOUBLE) || ' (' || ({li(JUDGE_LEVELS)})[least(k % 4, 2) + 1] || ', confidence 0.50)' END AS said
        FROM a JOIN items USING (changeset_id, id) WHERE k % 6 <> 5 AND (k % 2 = 0 OR k % 9 <> 0)"""
    ev_rank = f"coalesce(list_position({li(EVIDENCE_PRIORITY)}, string_split(p, '=')[1]) - 1, {len(EVIDENCE_PRIORITY)})"
    sql["escalation_items"] = f"""{DOC_ITEMS}, e0 AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY changeset_id ORDER BY severity_rank DESC, priority DESC, title, id)::INT AS pos FROM items2 WHERE category <> 'Mechanical' AND severity_rank >= 1),
        e1 AS (SELECT *, list_transform(list_sort(list_transform(proofs, (p, i) -> [lpad({ev_rank}::VARCHAR, 3, '0') || lpad(i::VARCHAR, 3, '0'), replace(p, '=', ': ')]))[1:8], r -> r[2]) AS lines FROM e0 WHERE pos <= 10)
        SELECT changeset_id, pos, id, title, why, ceil((length(title) + length(why) + length(id) + 32 + length(files[1]) + coalesce(list_sum(list_transform(lines, x -> length(x))), 0)) / 4)::INT AS approx_tokens,
               array_to_string(files, '|') AS files, array_to_string(lines, '|') AS proof FROM e1""".replace("items2", "(SELECT *, 0 AS pos FROM items)")
    sql["escalation_package"] = f"""{DOC_ITEMS}, e0 AS (SELECT *, row_number() OVER (PARTITION BY changeset_id ORDER BY severity_rank DESC, priority DESC, title, id) AS p FROM items WHERE category <> 'Mechanical' AND severity_rank >= 2),
        e1 AS (SELECT changeset_id, count(*)::INT AS items, sum(ceil((length(title) + length(why) + length(id) + 32 + length(files[1]) + coalesce(list_sum(list_transform(proofs[1:8], x -> length(x) + 1)), 0)) / 4))::BIGINT AS body FROM e0 WHERE p <= 10 GROUP BY ALL),
        st AS (SELECT changeset_id, count(*) AS files_changed, sum(added_lines)::BIGINT AS added_lines, sum(deleted_lines)::BIGINT AS deleted_lines FROM f GROUP BY ALL)
        SELECT changeset_id, 'High' AS floor, files_changed, added_lines, deleted_lines, coalesce(items, 0) AS items,
               coalesce(body, 0) + ceil(length('HEAD worktree High ' || files_changed || ' ' || added_lines || ' ' || deleted_lines) / 4)::BIGINT AS approx_tokens FROM st LEFT JOIN e1 USING (changeset_id)"""
    failed = "category <> 'Mechanical' AND severity_rank >= 2"
    sql["junit_cases"] = f"""{DOC_ITEMS} SELECT changeset_id, id, {failed} AS failed, category = 'Mechanical' AS skipped, '  <testcase classname="' || category || '" name="' || {xml("title")} || '">' ||
        CASE WHEN category = 'Mechanical' THEN '<skipped/>' WHEN {failed} THEN '<failure message="[' || severity || '] ' || {xml(single("title"))} || '">' || {xml(single("why"))} || '</failure>' ELSE '' END || '</testcase>' || chr(10) AS case FROM items"""
    meaningful = "m AS (SELECT *, row_number() OVER (PARTITION BY changeset_id ORDER BY severity_rank DESC, priority DESC, title, id)::INT AS n FROM items WHERE category <> 'Mechanical')"
    said = "array_to_string(list_transform(proofs, p -> substr(p, strpos(p, '=') + 1)), '; ')"
    prop = lambda x: f"replace(replace({github(x)}, ':', '%3A'), ',', '%2C')"
    sql["github_annotations"] = f"""{DOC_ITEMS}, {meaningful} SELECT changeset_id, n AS pos, '::' || CASE WHEN severity_rank >= 2 THEN 'error' WHEN severity_rank = 1 THEN 'warning' ELSE 'notice' END || ' file=' || {prop("files[1]")} ||
        ',title=' || severity || ' ' || {prop("title")} || '::' || {github(f"({single('why')} || CASE WHEN len(proofs) > 0 THEN ' | evidence: ' || {said} ELSE '' END)")} AS annotation FROM m"""
    sql["overview_lines"] = f"""{DOC_ITEMS}, {meaningful} SELECT changeset_id, n, n || '. [' || severity || '] ' || title || ' (priority ' || priority || ', 80% confidence)' || chr(10) || '    ' || why || chr(10) AS line FROM m"""
    sql["visible_items"] = f"""{DOC_ITEMS} SELECT changeset_id, id, row_number() OVER (PARTITION BY changeset_id ORDER BY severity_rank DESC, priority DESC, title, id)::INT AS shown_pos FROM items
        WHERE category <> 'Mechanical' AND (contains(lower(title), 'src1') OR len(list_filter(files, x -> contains(lower(x), 'src1'))) > 0)"""
    sql["next_meaningful"] = f"""{DOC_ITEMS} SELECT changeset_id, pos, id, min(CASE WHEN category NOT IN ('Mechanical', 'Test') THEN pos END) OVER (PARTITION BY changeset_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_pos FROM ranked"""
    sql["task_check"] = f"{check()} SELECT task_id, terms, matched, via, unmatched, CASE WHEN terms > 0 THEN round(matched / terms, 6) ELSE 0 END AS coverage, verdict FROM vd"
    sql["task_verdict_gate"] = f"{check()} SELECT task_id, verdict, verdict <> 'Covered' AS trips FROM vd"
    title = f"regexp_extract_all(regexp_extract(html, '<title>([^<]*)', 1), '{IDENTS}')[1:3]"
    sql["definition_index"] = f"WITH d AS (SELECT unnest({title}) AS name, {PAGE_PATH} AS file FROM pages) SELECT name, count(DISTINCT file) AS files FROM d GROUP BY name"
    sql["blast_radius"] = f"""WITH s AS (SELECT {PAGE_PATH} AS path, {CALLS} AS calls FROM pages),
        m AS (SELECT n_name, path FROM nation, s WHERE list_contains(calls, 'track') AND NOT {is_test_path("path")} AND path <> n_name), a AS (SELECT n_name, list_sort(list(DISTINCT path)) AS a FROM m GROUP BY n_name)
        SELECT 'file:' || n_name AS id, len(a)::INT AS n, md5(array_to_string(a, '|')) AS affected, {SUMMARY} AS summary FROM a"""
    sql["coverage_links"] = """WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, p_partkey // 5 AS g FROM part), c AS (SELECT 'src/' || p_partkey || '.rs' AS file, w[1] || '_' || g AS short FROM p),
        t AS (SELECT 'test_' || w[1] || '_' || g AS name, 'tests/' || p_partkey || '.rs' AS file, [w[1] || '_' || (g + 1), w[2] || '_' || g] AS calls FROM p),
        k AS (SELECT name, file, unnest(calls) AS key FROM t UNION ALL SELECT name, file, substr(name, 6) FROM t)
        SELECT DISTINCT 'parts' AS changeset_id, c.file, 'shop::' || c.short AS name, k.name || ' (' || k.file || ')' AS label FROM c JOIN k ON k.key = c.short"""
    sql["diff_rows"] = f"""WITH f AS (SELECT conv_id::VARCHAR AS changeset_id, turn, 'talk/' || conv_id || '/' || turn AS path, {lines("text")} AS l FROM conversations),
        r AS (SELECT changeset_id, turn, path, -1 AS hunk_idx, -1 AS line_idx, 'file' AS level, NULL AS kind, path AS text FROM f UNION ALL SELECT changeset_id, turn, path, 0, -1, 'hunk', NULL, 'untracked file' FROM f
              UNION ALL SELECT changeset_id, turn, path, 0, generate_subscripts(l, 1)::INT - 1, 'line', 'Addition', unnest(l) FROM f)
        SELECT changeset_id, row_number() OVER (PARTITION BY changeset_id ORDER BY turn, hunk_idx, line_idx)::INT AS row, level, path, hunk_idx, line_idx, kind, text FROM r"""
    sql["progress_by_generation"] = "SELECT user_id % 4 AS generation, count(DISTINCT CASE WHEN event_type <> 'purchase' THEN event_id END) AS analysed, count(*) FILTER (event_type = 'purchase') AS finished FROM events GROUP BY 1"
    sql["progress_drained"] = "SELECT count(DISTINCT CASE WHEN event_type <> 'purchase' THEN event_id END) AS analysed, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS last_finished, max(CASE WHEN event_type = 'purchase' THEN event_id END) IS NOT NULL AS done FROM events WHERE user_id % 4 = 2"
    key = "sha256(encode(lang) || '\\x00'::BLOB || encode(coalesce(text, '')))"
    sql["cache_metrics"] = f"""WITH k AS (SELECT doc_id, {key} AS k FROM documents), h AS (SELECT k.k IN (SELECT k FROM k WHERE doc_id % 2 = 0) AS hit FROM k)
        SELECT count(*) AS lookups, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*), 6) AS hit_rate FROM h"""
    key = "sha256(encode('rust') || '\\x00'::BLOB || encode(o_orderkey::VARCHAR))"
    sql["cache_eviction"] = f"""WITH k AS (SELECT {key} AS k FROM orders), n AS (SELECT count(*) AS n FROM k), r AS (SELECT k, row_number() OVER (ORDER BY k DESC) AS rn FROM k)
        SELECT count(*) AS n, min(k) AS least, max(k) AS most FROM r, n WHERE n.n < 5000 OR rn <= n.n - greatest(625, n.n - 5000 + 625)"""
    of_symbols = f"WITH {CHANGES}, {FILES}, {line_symbols()}, {DIFF}"
    per_file = "pf AS (SELECT changeset_id, file AS path, count(*) FILTER (change = 'Added') AS a, count(*) FILTER (change = 'Modified') AS m, count(*) AS n FROM sd GROUP BY ALL)"
    s = lambda n: f"CASE WHEN {n} = 1 THEN '' ELSE 's' END"
    sql["tests_bucket"] = f"""{of_symbols}, pf AS (SELECT changeset_id, file AS path, count(*) FILTER (change = 'Added') AS a, count(*) FILTER (change = 'Modified') AS m FROM sd WHERE change IN ('Added', 'Modified') GROUP BY ALL),
        b AS (SELECT f.changeset_id, count(*) AS k, sum(a)::BIGINT AS a, sum(m)::BIGINT AS m, list(path ORDER BY file_idx, path) AS files FROM f JOIN pf USING (changeset_id, path)
              WHERE is_test_file AND NOT is_generated AND NOT formatting_only GROUP BY ALL)
        SELECT changeset_id, CASE WHEN a > 0 THEN 'Tests — ' || a || ' new test symbol' || {s("a")} ELSE 'Tests' END || CASE WHEN m > 0 THEN ', ' || m || ' modified' ELSE '' END || ' across ' || k || ' file' || {s("k")} AS title,
               len(files)::INT AS n, md5(array_to_string(files, '|')) AS files, (1 + least(m, 10))::INT AS proofs FROM b"""
    sql["move_pairs"] = f"""{EXACT}, p AS (SELECT changeset_id, moved_from, file, count(*) AS k, min(confidence) AS c, list(name ORDER BY name, kind, new_start) AS names FROM mv WHERE change = 'Moved' AND moved_from IS NOT NULL GROUP BY ALL)
        SELECT changeset_id, 'move:' || moved_from || '→' || file AS id, CASE WHEN k = 1 THEN names[1] ELSE k || ' symbols' END || ' moved ' || moved_from || ' → ' || file AS title, CASE WHEN c < 0.8 THEN 'Medium' ELSE 'Low' END AS severity,
               CASE WHEN c < 0.8 THEN 25 ELSE 8 END AS priority, k::INT AS n, md5(array_to_string(names, '|')) AS names FROM p"""
    sql["change_stats"] = f"""{of_symbols}, ff AS (SELECT * FROM f), x AS (SELECT changeset_id, count(*) FILTER (change = 'Added') AS symbols_added, count(*) FILTER (change = 'Removed') AS symbols_removed,
              count(*) FILTER (change NOT IN ('Added', 'Removed')) AS symbols_modified FROM sd GROUP BY ALL)
        SELECT changeset_id, count(*) AS files_changed, sum(added_lines)::BIGINT AS added_lines, sum(deleted_lines)::BIGINT AS deleted_lines, count(*) FILTER (is_generated OR formatting_only) AS mechanical_files,
               count(*) FILTER (is_test_file) AS test_files, coalesce(any_value(symbols_added), 0) AS symbols_added, coalesce(any_value(symbols_removed), 0) AS symbols_removed, coalesce(any_value(symbols_modified), 0) AS symbols_modified,
               count(*) FILTER (NOT (is_generated OR formatting_only) AND added_lines + deleted_lines > 0) AS meaningful_changes FROM ff LEFT JOIN x USING (changeset_id) GROUP BY changeset_id"""
    verbs = "CASE sy[1].change WHEN 'Added' THEN 'added' WHEN 'Removed' THEN 'removed' WHEN 'SignatureChanged' THEN 'signature changed' WHEN 'VisibilityChanged' THEN 'visibility changed' ELSE 'modified' END"
    sql["file_items"] = f"""{of_symbols}, {per_file.replace("GROUP BY ALL", "GROUP BY ALL")},
        ss AS (SELECT changeset_id, file AS path, list({{'name': name, 'kind': kind, 'change': change}} ORDER BY name, kind, coalesce(new_start, old_start), change) AS sy FROM sd GROUP BY ALL),
        j AS (SELECT f.*, coalesce(sy, []) AS sy, coalesce(list_transform(sy, x -> {{'name': x.name, 'change': x.change}}), []) AS symbols, coalesce(pf.n, 0) AS k, coalesce(pf.a + pf.m, 0) AS am FROM f LEFT JOIN ss USING (changeset_id, path) LEFT JOIN pf USING (changeset_id, path)),
        {scored("j")}
        SELECT changeset_id, 'file:' || path AS id, CASE WHEN k = 1 THEN path || ' — ' || sy[1].name || ' ' || {verbs} WHEN k > 1 THEN path || ' — ' || k || ' symbols changed' WHEN status = 'Added' THEN path || ' — new file'
               ELSE path || ' — +' || added_lines || ' −' || deleted_lines END AS title, category, {SEVERITY} AS severity, priority,
               CASE WHEN k = 0 THEN 'No parseable symbols changed in this file (' || path || '). Review the raw diff.'
                    ELSE array_to_string(list_transform(sy[1:5], x -> x.kind || ' ' || x.name || ' (' || x.change || ')'), '; ') || CASE WHEN k > 5 THEN '; …and ' || (k - 5) || ' more' ELSE '' END END AS why, k::INT AS n
        FROM sc WHERE NOT (is_generated OR formatting_only) AND NOT (is_test_file AND k > 0 AND am = k) AND NOT (k = 0 AND added_lines + deleted_lines = 0)"""
    sql["snapshot_changes"] = """WITH r AS (SELECT 'talk/' || conv_id || '/' || turn // 2 AS path, turn % 2 AS k, text FROM conversations), o AS (SELECT path, text AS o FROM r WHERE k = 0), n AS (SELECT path, text AS n FROM r WHERE k = 1)
        SELECT path, CASE WHEN o IS NULL THEN 'Added' WHEN n IS NULL THEN 'Deleted' ELSE 'Modified' END AS status, md5(o) AS old, md5(n) AS new FROM o FULL OUTER JOIN n USING (path) WHERE o IS DISTINCT FROM n"""
    change = lambda kind, c: f"SELECT changeset_id, path, '{kind}' AS kind, {c} AS texts, len(deleted) AS nd FROM df"
    sql["item_detail"] = f"""WITH {TALKS}, {FILES}, df AS (SELECT DISTINCT changeset_id, path, added, deleted FROM f), p AS (SELECT changeset_id, path, count(*) AS k FROM df GROUP BY ALL),
        u AS (SELECT changeset_id, path, kind, unnest(texts) AS text, nd FROM ({change("Deletion", "deleted")} UNION ALL {change("Addition", "added")}))
        SELECT u.changeset_id, 'all' AS id, u.path, u.kind, u.text FROM u JOIN p USING (changeset_id, path), range(p.k)"""
    names = ("Wagon{k}|barn{k}|hay|load", "bytes|io|net|txt{k}", "Farm|Grain{k}", "barn{k}|fill|load|silo", "barn|json|load|math|numbers{k}", "")
    languages = ("Rust", "Go", "CSharp", "TypeScript", "Python", "Java")
    sql["imported_names"] = f"SELECT p_partkey, {pick(languages, 'p_partkey')} AS language, replace({pick(names, 'p_partkey')}, '{{k}}', p_partkey::VARCHAR) AS imports FROM part"
    rows = ", ".join(f"({kind}, {i}, {q(name)}, {q(what)}, {first}, {last}, {q(signature)}, {test}, {public})" for kind, i, name, what, first, last, signature, test, public in CODE_SYMBOLS)
    sql["extract_code_symbols"] = f"""WITH g(kind_no, sym_idx, name, kind, start_line, end_line, signature, is_test, is_public) AS (VALUES {rows})
        SELECT 'src/f' || p_partkey || '.' || {pick(("py", "rs", "go", "ts", "cs"), "p_partkey")} AS file, sym_idx::INT AS sym_idx, replace(name, '{{k}}', p_partkey::VARCHAR) AS name, kind, start_line::INT AS start_line, end_line::INT AS end_line,
               replace(signature, '{{k}}', p_partkey::VARCHAR) AS signature, is_test, is_public FROM part JOIN g ON kind_no = p_partkey % 5"""
    hit = re.sub(r" FROM part JOIN g", ", p_partkey % 2 = 0 AS hit FROM part JOIN g", sql["extract_code_symbols"])
    sql["cached_extraction"] = hit
    sql["stored_versions"] = "SELECT n_nationkey::VARCHAR AS changeset_id, CASE WHEN n_nationkey % 3 = 0 THEN 1 ELSE n_nationkey END::INT AS schema_version, n_name AS base_ref, 1 AS items, 'High' AS severity FROM nation"
    sql["overview"] = f"""{DOC_ITEMS}, {meaningful}, b AS (SELECT changeset_id, count(*) AS k, string_agg(n || '. [' || severity || '] ' || title || ' (priority ' || priority || ', 80% confidence)' || chr(10) || '    ' || why || chr(10), '' ORDER BY n) AS body FROM m GROUP BY ALL),
        st AS (SELECT changeset_id, count(*) AS nf, sum(added_lines)::BIGINT AS a, sum(deleted_lines)::BIGINT AS d, count(*) FILTER (is_generated OR formatting_only) AS mf FROM f GROUP BY ALL),
        me AS (SELECT changeset_id, count(*) AS n, string_agg('  - ' || title || chr(10), '' ORDER BY pos) AS l FROM ranked WHERE category = 'Mechanical' GROUP BY ALL)
        SELECT changeset_id, 'HEAD → worktree' || chr(10) || nf || ' files · +' || a || ' −' || d || ' · ' || coalesce(k, 0) || ' meaningful · ' || mf || ' mechanical' || chr(10) || chr(10) || coalesce(body, '')
               || coalesce(chr(10) || 'Mechanical (collapsed): ' || me.n || ' item(s)' || chr(10) || l, '') AS overview FROM st LEFT JOIN b USING (changeset_id) LEFT JOIN me USING (changeset_id)"""
    sql["escalation_summary"] = f"""{DOC_ITEMS}, e0 AS (SELECT *, row_number() OVER (PARTITION BY changeset_id ORDER BY severity_rank DESC, priority DESC, title, id) AS p FROM items WHERE category <> 'Mechanical' AND severity_rank >= 2),
        e1 AS (SELECT *, ceil((length(title) + length(why) + length(id) + 32 + length(files[1]) + coalesce(list_sum(list_transform(proofs[1:8], x -> length(x) + 1)), 0)) / 4)::BIGINT AS t FROM e0 WHERE p <= 3),
        e2 AS (SELECT changeset_id, count(*) AS k, sum(t)::BIGINT AS t, string_agg(p || '. [' || severity || '] ' || title || ' (~' || t || ' tokens)' || chr(10) || '    ' || {single("why")} || chr(10) || '    files: ' || files[1] || chr(10), '' ORDER BY p) AS l FROM e1 GROUP BY ALL),
        st AS (SELECT changeset_id, count(*) AS n, sum(added_lines)::BIGINT AS a, sum(deleted_lines)::BIGINT AS d FROM f GROUP BY ALL)
        SELECT changeset_id, chr(10) || 'Escalation package — ' || coalesce(k, 0) || ' item(s), ~' || (coalesce(t, 0) + ceil(length('HEAD worktree High ' || n || ' ' || a || ' ' || d) / 4)::BIGINT) || ' tokens, floor High (schema v1)' || chr(10)
               || CASE WHEN k IS NULL THEN '  no items at or above the floor — nothing to escalate.' ELSE l || '  pipe the JSON package to your model' END || chr(10) AS summary FROM st LEFT JOIN e2 USING (changeset_id)"""
    facts = "{'id': id, 'title': title, 'category': category, 'severity': severity, 'priority': priority, 'confidence': 0.8, 'files': files, 'symbols': []::VARCHAR[], 'evidence': list_transform(proofs, p -> substr(p, strpos(p, '=') + 1)), 'why': why}"
    criteria = "{'true': " + q(RISK_CRITERIA["true"]) + ", 'false': " + q(RISK_CRITERIA["false"]) + "}"
    risk = f"to_json({{'type': 'noul', 'instructions': {{'change': {facts}, 'question': {q(RISK_QUESTION)}}}, 'criteria': {criteria}}})"
    severe = f"to_json({{'type': 'score', 'instructions': {{'change': {facts}, 'question': {q(SEVERITY_QUESTION)}}}, 'criteria': {li(JUDGE_LEVELS)}}})"
    sql["judge_requests"] = f"""{DOC_ITEMS}, {judged}, r AS (SELECT changeset_id, pos, to_json(id || '::risk') || ':' || {risk} || ',' || to_json(id || '::severity') || ':' || {severe} AS t FROM jd WHERE pos <= 25)
        SELECT changeset_id, '{{"model":"judge","state":{{"base":"HEAD","head":"worktree","items_under_review":' || count(*) || '}},"questions":{{' || string_agg(t, ',' ORDER BY pos) || '}}}}' AS request FROM r GROUP BY changeset_id"""
    proofs = "list_transform(proofs, p -> {'kind': substr(p, 1, strpos(p, '=') - 1), 'summary': substr(p, strpos(p, '=') + 1), 'file': CASE WHEN category = 'Mechanical' THEN '' ELSE files[1] END, 'old_value': NULL::VARCHAR, 'new_value': NULL::VARCHAR})"
    sql["changeset_json"] = f"""{DOC_ITEMS}, fl AS (SELECT changeset_id, list({{'file_idx': file_idx, 'path': path, 'status': status, 'language': language, 'added_lines': added_lines, 'deleted_lines': deleted_lines}} ORDER BY file_idx, path) AS files FROM f GROUP BY ALL),
        it AS (SELECT changeset_id, list({{'id': id, 'title': title, 'category': category, 'severity': severity, 'priority': priority, 'confidence': confidence::DOUBLE, 'files': files, 'symbols': []::VARCHAR[], 'evidence': {proofs}, 'why': why}} ORDER BY pos) AS items FROM ranked GROUP BY ALL),
        st AS (SELECT changeset_id, {{'files_changed': count(*), 'added_lines': sum(added_lines)::BIGINT, 'deleted_lines': sum(deleted_lines)::BIGINT, 'mechanical_files': count(*) FILTER (is_generated OR formatting_only), 'test_files': count(*) FILTER (is_test_file),
               'symbols_added': 0, 'symbols_removed': 0, 'symbols_modified': 0, 'meaningful_changes': count(*) FILTER (NOT (is_generated OR formatting_only) AND added_lines + deleted_lines > 0)}} AS stats FROM f GROUP BY ALL)
        SELECT changeset_id, to_json({{'schema_version': 1, 'repo_root': '', 'base_ref': 'HEAD', 'head_ref': 'worktree', 'files': fl.files, 'symbol_changes': []::VARCHAR[], 'review_items': items, 'stats': stats}})::VARCHAR AS json
        FROM st JOIN fl USING (changeset_id) LEFT JOIN it USING (changeset_id)"""
    sql["junit"] = f"""WITH c AS ({sql["junit_cases"]}) SELECT changeset_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<testsuite name="tidemark" tests="' || count(*) || '" failures="' || count(*) FILTER (failed) || '" skipped="' ||
        count(*) FILTER (skipped) || '">' || chr(10) || string_agg("case", '' ORDER BY id) || '</testsuite>' || chr(10) AS junit FROM c GROUP BY changeset_id"""
    return {name: _lambdas(text) for name, text in sql.items()}


def _lambdas(text: str) -> str:
    """Arrows of lambdas in the notation that DuckDB keeps."""
    return re.sub(r"\b(\w+) -> ", r"lambda \1: ", re.sub(r"\((\w+), (\w+)\) -> ", r"lambda \1, \2: ", text))
