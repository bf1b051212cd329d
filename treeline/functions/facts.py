"""What names, calls and file names say by themselves, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from treeline.functions import paths as P
from treeline.functions import text as T

# Last parts of calls that register routes, read and write files; files that hold settings; folders and files of deployment platforms.
ROUTE_CALLS = ["route", "add_route", "map_get", "map_post", "map_put", "map_patch", "map_delete"]
READ_CALLS = ["read", "read_to_string", "readfile", "readfilesync"]
WRITE_CALLS = ["write", "writefile", "writefilesync", "create"]
ENV_CALLS = ["getenv", "getenv_os"]
ENV_ENDINGS = ["env::var", "env::var_os", "os.getenv", "getenvironmentvariable"]
CONFIG_NAMES = ["config.json", "config.yaml", "config.yml", "config.toml", "settings.json", "settings.yaml", "settings.yml", "settings.toml", "appsettings.json"]
COMPOSE_NAMES = ["compose.yaml", "compose.yml", "docker-compose.yaml", "docker-compose.yml"]
CLUSTER_NAMES = ["chart.yaml", "kustomization.yaml", "kustomization.yml"]
CLUSTER_FOLDERS = ["k8s", "kubernetes", "helm", "kustomize"]
# Names whose change asks for a full scan.
FULL_SCAN_NAMES = [".gitignore", ".ignore", "tsconfig.json", "jsconfig.json"]
STRIPPED = [".d.ts", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".py", ".rs"]


def static_argument(call: Column) -> Column:
    """The first argument of a call if it is one plain string literal, else null: no escape, no ${ or #{, no control character."""
    value = F.when(call.rlike(r"^[^(]*\(\s*\"[^\"]*\""), F.regexp_extract(call, r"^[^(]*\(\s*\"([^\"]*)\"", 1)).when(call.rlike(r"^[^(]*\(\s*'[^']*'"), F.regexp_extract(call, r"^[^(]*\(\s*'([^']*)'", 1))
    return F.when(~value.rlike(r"\\|\$\{|#\{|\p{Cntrl}"), value)


def route_handler(target: Column, call: Column, caller: Column) -> Column:
    """The handler a route registration names: a plain path, one comma, then an identifier other than the caller's."""
    handler = F.btrim(F.regexp_replace(F.btrim(F.regexp_extract(call, r"^.*,([^,]*)$", 1)), r"[);]+$", ""))
    commas = F.char_length(call) - F.char_length(F.replace(call, F.lit(","), F.lit("")))
    good = T.call_leaf(target).isin(ROUTE_CALLS) & static_argument(call).startswith("/") & (commas == 1) & handler.rlike(r"^[A-Za-z_:.$][A-Za-z0-9_:.$]*$") & (handler != F.coalesce(caller, F.lit("")))
    return F.when(good, F.regexp_replace(handler, r"^\$+|\$+$", ""))


def environment_key(target: Column, call: Column) -> Column:
    """The variable a call reads from the environment, if its name is plain."""
    low = T.ascii_lower(F.regexp_replace(F.btrim(target), "!+$", ""))
    asks = low.isin(ENV_CALLS)
    for x in ENV_ENDINGS:
        asks = asks | low.endswith(x)
    key = static_argument(call)
    return F.when(asks & key.rlike(r"^[A-Z0-9_]{1,128}$"), key)


def data_access(target: Column) -> Column:
    """'reads' or 'writes' for calls of known file functions, else null."""
    low = T.ascii_lower(F.regexp_replace(F.btrim(target), "!+$", ""))
    leaf = T.call_leaf(low)
    return F.when(leaf.isin(READ_CALLS) | low.endswith("file::open"), "reads").when(leaf.isin(WRITE_CALLS) | low.endswith("file::create"), "writes")


def static_path(value: Column) -> Column:
    """A literal as a path of the repository; null for absolute ones, addresses, templates and those that leave it."""
    v = F.translate(value, "\\", "/")
    bad = (v == "") | v.rlike(r"^[/~]|://|[${}]|^[^/]*:|\p{Cntrl}|(^|/)\s+[^/]|[^/]\s+(/|$)")
    out = P.resolve_relative(F.lit("."), v)
    return F.when(~bad & (out != ""), out)


def config_identity(path: Column) -> Column:
    """'dotenv' or 'application-config' for files that hold settings, else null."""
    name = F.lower(P.basename(F.translate(path, "\\", "/")))
    return F.when((name == ".env") | name.startswith(".env."), "dotenv").when(name.isin(CONFIG_NAMES), "application-config")


def deploy_platform(path: Column) -> Column:
    """The platform a deployment file is for, else null."""
    low = F.lower(F.translate(path, "\\", "/"))
    name = P.basename(low)
    terraform = name.rlike(r"[^/]\.tf(\.json)?$")
    containers = (name == "dockerfile") | name.startswith("dockerfile.") | name.isin(COMPOSE_NAMES)
    cluster = name.isin(CLUSTER_NAMES) | F.exists(F.split(low, "/"), lambda x: x.isin(CLUSTER_FOLDERS))
    cloud = (name == "sam-template.yaml") | (name.contains("cloudformation") & name.rlike(r"\.(yaml|yml|json)$"))
    return F.when(terraform, "terraform").when(containers, "containers").when(cluster, "kubernetes").when(name.rlike(r"[^/]\.bicep$"), "azure-bicep").when(cloud, "cloudformation").when(name.isin("playbook.yaml", "playbook.yml"), "ansible")


def qualified_parts(target: Column) -> tuple[Column, Column]:
    """(scope, name) of a target split at its last '::' or '.', whichever comes later; null without either."""
    t = F.btrim(target)
    rx = r"^(.*)(?:::|\.)((?:(?!::)[^.])*)$"
    return F.when(t.rlike(rx), F.regexp_extract(t, rx, 1)), F.when(t.rlike(rx), F.regexp_extract(t, rx, 2))


def source_stem(path: Column) -> Column:
    """The path without a known source extension."""
    return F.regexp_replace(path, r"(\.d\.ts|\.ts|\.tsx|\.js|\.jsx|\.mjs|\.cjs|\.py|\.rs)$", "")


def source_stems(path: Column) -> Column:
    """The stem of a source path and, for a package's entry file, its folder."""
    stem = source_stem(path)
    return F.array_sort(F.when(stem.rlike("/(index|__init__|mod)$"), F.array(stem, F.regexp_replace(stem, "/[^/]*$", ""))).otherwise(F.array(stem)))


def module_aliases(path: Column) -> Column:
    """All names a module goes by: its parts joined by '::' and by '.', and the last one; entry names and a leading src dropped."""

    def names(stem: Column) -> Column:
        parts = F.filter(F.split(stem, "/"), lambda x: x != "")
        parts = F.when(F.element_at(parts, 1) == "src", F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))).otherwise(parts)
        last = F.get(parts, F.size(parts) - 1)
        parts = F.when(last.isin("lib", "main", "mod", "index", "__init__"), F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
        return F.when(F.size(parts) > 0, F.array(F.array_join(parts, "::"), F.array_join(parts, "."), F.element_at(parts, -1))).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(source_stems(path), names))))


def target_aliases(path: Column, name: Column) -> Column:
    """Qualified names that stand for a symbol of a file."""
    mods = module_aliases(path)
    every = F.flatten(F.transform(mods, lambda m: F.array(F.concat(m, F.lit("::"), name), F.concat(m, F.lit("."), name), F.concat(F.lit("crate::"), m, F.lit("::"), name), F.concat(F.lit("crate."), m, F.lit("."), name))))
    return F.array_sort(F.array_distinct(F.when(F.size(mods) > 0, every).otherwise(F.array(F.concat(F.lit("crate::"), name), F.concat(F.lit("self::"), name)))))


def finding_id(category: Column, path: Column, related: Column) -> Column:
    return F.concat_ws(":", category, path, F.coalesce(related, F.lit("")))


def baseline_identity(kind: Column, command: Column, path: Column, query: Column) -> Column:
    star = F.lit("*")
    return F.concat(kind, F.lit(":command="), command, F.lit(":path="), F.coalesce(path, star), F.lit(":query="), F.coalesce(query, star))


def fallback_summary(summary: Column) -> Column:
    """Whether a summary only gives the number of bytes."""
    return F.coalesce(summary.rlike(r", [0-9]+ bytes\.*$"), F.lit(False))


def exact_query(query: Column) -> Column:
    return F.lower(F.translate(F.btrim(query), "\\", "/"))


def valid_revision(value: Column) -> Column:
    """Whether a revision may be handed to a version control command: plain characters, no option, no range."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9_./^~][A-Za-z0-9_./^~-]{0,255}$") & ~value.contains(".."), F.lit(False))


def requires_full_scan(path: Column) -> Column:
    """Whether a change of the path can change which other files belong to the index."""
    return (path == ".") | P.basename(path).isin(FULL_SCAN_NAMES) | path.rlike(r"(^|/)\.git(/info/exclude)?$")


def watch_admitted(path: Column) -> Column:
    """Whether a watcher's path is a safe relative one: no empty, '.' or '..' part; the root itself is."""
    return (path == ".") | ~F.exists(F.split(path, "/"), lambda x: x.isin("", ".", ".."))
