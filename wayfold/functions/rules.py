"""Rule tables as CASE expressions: classes, levels, fallbacks, weights and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import c, clamp, escape_html, floor_name, number_prefix, round_to, round_up

# Layer-name patterns and their classes, in order; the first that matches counts.
LAYER_CLASSES = [
    ("room_no", r"ROOM_NO|RM\$TXT|ROOM ?NUM"),
    ("elevator", r"ELEV|ELEVATOR|\bELV\b"),
    ("stair", r"STAIR|\bSTR\b|ESCAL"),
    ("door", r"DOOR|\bDW\b|\bDT\d"),
    ("window", r"WINDOW|\bWIN\b"),
    ("column", r"COLUMN|\bCOL\b"),
    ("wall", r"WALL|\bWL\d?\b|\bWL-|\bW[23]\b"),
    ("corridor", r"CORRIDOR"),
    ("space", r"SPACE|B-SP-SOLID"),
    ("title", r"TITLE|SCALE|NORTH|LEGEND|KEY"),
    ("site", r"SIDEWALK|DRIVE|MAINBUILDING|PARKING|B-SP-"),
    ("fixture", r"FIXTURE|PLUMB|\bWC\b|FURN|MECH|METAL|CASE"),
]
# Names of wings that may stand before a floor's label.
WINGS = ["central complex", "community centre", "commons", r"village \d+ ?- ?\w+", "beck hall", r"\w+ hall"]
# Weights, limits and speeds of routing.
INTRA_FACTOR, STAIR_PENALTY, FALLBACK_FACTOR, OUTDOOR_PENALTY = 1.25, 1.15, 2.5, 1.6
WALK_SPEED, PLAY_SPEED = 1.3, 1.6


def first_match(text: Column | str, rules: list[tuple[str, str]], otherwise: str = "other", empty: str = "unlayered") -> Column:
    """The name of the first rule whose pattern is found, in any case."""
    text = c(text)
    out = F.when(F.coalesce(text, F.lit("")) == "", F.lit(empty))
    for name, pattern in rules:
        out = out.when(text.rlike("(?i)" + pattern), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def layer_class(layer: Column | str) -> Column:
    return first_match(layer, LAYER_CLASSES)


def tier(layered: Column, room_numbers: Column) -> Column:
    return F.when(layered & (F.coalesce(room_numbers, F.lit(0)) > 0), "A").when(layered, "B").otherwise("C")


def building_code(name: Column | str) -> Column:
    """'ABC - Name', 'ABC and DEF ...' to the code at the front; 'IHB-' loses its hyphen."""
    return F.replace(F.trim(F.split(F.split(c(name), " - ")[0], " and ")[0]), F.lit("IHB-"), F.lit("IHB"))


def level_of_label(label: Column | str) -> Column:
    """A floor's level from its label, null where it says none."""
    low = F.lower(F.trim(c(label)))
    bare = F.when(low.rlike("^(lower|mid)"), low).otherwise(F.regexp_replace(low, f"^({'|'.join(WINGS)})\\s+", ""))
    n = F.regexp_extract(bare, r"^(\d+)(?:st|nd|rd|th)\s+floor", 1)
    return (
        F.when(bare.contains("midlevel basement"), -1.5)
        .when(bare.contains("basement"), -1.0)
        .when(bare.isin("concourse", "lower level"), -1.0)
        .when(bare == "link", 0.0)
        .when(bare == "mezzanine", 0.5)
        .when(bare.contains("penthouse"), 90.0)
        .when(n != "", n.try_cast("double") - 1 + F.when(bare.rlike(r"^\d+(?:st|nd|rd|th)\s+floor\s+mezzanine"), 0.5).otherwise(0.0))
    )


def level_of_file(name: Column | str) -> Column:
    """A floor's level from the token in its file name, null where there is none."""
    up = F.upper(c(name))
    token = F.regexp_extract(up, r"_(\d{2}FLR|B1FLR|MBFLR|LLFLR|0M_MEZ|0B_CON)(?:_MEZ)?\.PDF$", 1)
    n = F.regexp_extract(token, r"^(\d{2})FLR", 1).try_cast("double")
    base = F.when(n.isNotNull(), F.greatest(n - 1, F.lit(0.0))).when(token.isin("B1FLR", "LLFLR", "0B_CON"), -1.0).when(token == "MBFLR", -1.5).when(token == "0M_MEZ", 0.5)
    return base + F.when(up.rlike(r"(?:FLR|0M_MEZ|0B_CON)_MEZ\.PDF$"), 0.5).otherwise(0.0)


def level(label: Column | str, name: Column | str) -> Column:
    """The label's level wins; the file's is the fallback."""
    return F.coalesce(level_of_label(label), level_of_file(name))


def floor_height(height: Column | str, levels: Column | str) -> Column:
    h = c(height) / F.when(c(levels) > 0, c(levels))
    return F.when((c(height) != 0) & h.between(3.0, 5.5), F.round(h, 2)).otherwise(4.0)


def elevation(level: Column | str, height: Column | str) -> Column:
    return F.round(c(level) * c(height), 2)


def building_height(height: Column | str, levels: Column | str) -> Column:
    """Height, else 3.5 m a level, else 12 m; texts may go on after the number."""
    return F.coalesce(number_prefix(height), number_prefix(levels) * 3.5, F.lit(12.0))


def campus(operator: Column, ref: Column, short: Column, name: Column | None, owner: str) -> Column:
    """Whether a building is the owner's. Ways also count by name (name given), relations don't (None)."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    out = yes(operator.contains(owner)) | yes(ref != "") | yes(short != "")
    return out | yes(name.rlike(f"(?i){owner}")) if name is not None else out


def way_kind(kind: Column, building: Column, points: Column) -> Column:
    """Where a map element belongs; null where it is skipped."""
    return F.when((kind == "relation") & building.isNotNull(), "relation building").when((kind == "way") & points.isNotNull() & building.isNotNull(), F.when(F.size(points) >= 4, F.lit("way building"))).when((kind == "way") & points.isNotNull(), "other")


def footway_factor(highway: Column | str) -> Column:
    return F.when(c(highway) == "steps", 1.5).when(c(highway).isin("residential", "service"), 1.15).otherwise(1.0)


def clean_text(x: Column | str) -> Column:
    return F.regexp_replace(F.upper(c(x)), "[^0-9A-Z.-]", "")


def plausible_room(text: Column | str, level: Column | str) -> Column:
    text, level = c(text), c(level)
    digits = F.regexp_extract(text, "^([0-9]+)", 1)
    return text.rlike("^[0-9]{3,4}[A-Z]{0,2}$") & ((level < 0) | (F.length(digits) == 3) | text.startswith(F.floor(level + 1).cast("string")))


def georef_method(iou: Column | str, margin: Column | str, residual: Column | str) -> Column:
    ok = (c(iou) >= 0.62) & (c(margin) >= 0.04) & (c(residual) <= 6)
    return F.when(c(iou).isNull(), "no-footprint").when(ok, "auto").otherwise("needs-review")


def shift_trusted(score: Column | str, in_footprint: Column | str) -> Column:
    return (c(score) >= 0.60) & (c(in_footprint) >= 0.5)


def moved(dx: Column | str, dy: Column | str, degrees: Column | str) -> Column:
    return (F.abs(c(dx)) > 3) | (F.abs(c(dy)) > 3) | (F.coalesce(c(degrees), F.lit(0.0)) != 0)


def visible(kind: Column | str, verified: Column | str, kinds: list[str], unverified: bool) -> Column:
    return c(kind).isin(kinds) & (F.lit(unverified) | c(verified))


def matches(query: str, *columns: Column | str) -> Column:
    """Whether any column contains the trimmed query in any case; an empty one matches all."""
    q = query.strip().lower()
    out = F.lit(not q)
    for x in columns:
        out = out | F.coalesce(F.lower(c(x)).contains(q), F.lit(False))
    return out


def casts_shadow(kind: Column | str) -> Column:
    """Doorways have no length to cast a shadow."""
    return c(kind) != "doorway"


def kind_rank(kind: Column | str) -> Column:
    return F.when(c(kind) == "tunnel", 0).when(c(kind) == "bridge", 1).otherwise(2)


def link_name(name: Column | str, a: Column | str, b: Column | str) -> Column:
    return F.coalesce(c(name), F.concat(c(a), F.lit(" – "), c(b)))


def link_source(ways: Column | str) -> Column:
    ways = c(ways)
    return F.when(F.size(F.coalesce(ways, F.array().cast("array<long>"))) > 0, F.concat(F.lit("osm:"), F.array_join(F.transform(ways, lambda w: w.cast("string")), ","))).otherwise("traced")


# Colours of links by kind, and of a closed one.
COLOURS = {"tunnel": (255, 140, 26), "bridge": (45, 212, 255), "doorway": (163, 173, 189)}
CLOSED = (255, 77, 109)


def link_style(kind: Column | str, status: Column | str, id_: Column | str, highlight: str | None, alpha: int = 255, dim: float = 1.0) -> Column:
    """(r, g, b, a, width) of a link."""
    kind, id_ = c(kind), c(id_)
    out = []
    for i, name in enumerate("rgb"):
        x = F.when(c(status) == "closed", CLOSED[i])
        for k, v in COLOURS.items():
            x = x.when(kind == k, v[i])
        out.append(x.alias(name))
    other = F.lit(False) if highlight is None else id_ != highlight
    mine = F.lit(False) if highlight is None else id_ == highlight
    return F.struct(*out, round_up(F.lit(float(alpha)) * F.when(other, 0.35).otherwise(1.0) * dim).alias("a"), (F.when(kind == "doorway", 1.6).otherwise(3.2) * F.when(mine, 1.6).otherwise(1.0)).alias("width"))


def vertical_metres(kind: Column | str, diagonal: Column | str, rise: Column | str) -> Column:
    """1.8 times the shaft's diagonal and the rise by stairs; the rise and 12 m by elevator."""
    rise = F.abs(c(rise))
    return F.when(c(kind) == "stair", c(diagonal) * 1.8 + rise).otherwise(rise + 12)


def arc_weight(kind: Column | str, m: Column | str, outdoor: float = OUTDOOR_PENALTY) -> Column:
    return c(m) * F.when(c(kind) == "outdoor", outdoor).when(c(kind) == "stair", STAIR_PENALTY).otherwise(1.0)


def minutes(m: Column | str) -> Column:
    return c(m) / WALK_SPEED / 60


def shown_minutes(m: Column | str) -> Column:
    return F.greatest(F.lit(1), round_up(minutes(m)))


def pitch(climb: Column | str) -> Column:
    return clamp(F.lit(82.0) - c(climb) * 40, 70.0, 85.0)


def underground(z: Column | str) -> Column:
    return c(z) < -0.5


def level_shown(level: Column | str, view: float, span: float) -> Column:
    return (c(level) <= view) & (F.lit(view) - c(level) <= span)


def route_lift(kind: Column | str) -> Column:
    return F.when(c(kind).isin("walk", "vertical"), 0.12).otherwise(0.0)


def _bold(x: Column) -> Column:
    return F.concat(F.lit("<b>"), escape_html(x), F.lit("</b>"))


def step_text() -> Column:
    """The sentence of a collapsed step with columns kind, building, level, to_level, vertical, m, to, link_kind, link_name, z_m, length_m, verified."""
    place = lambda lv: _bold(F.concat_ws(" ", "building", floor_name(lv)))
    about = F.concat(F.lit(" (≈ "), round_to("m", 5).cast("string"), F.lit(" m)."))
    how = F.when(F.col("vertical") == "elevator", "Take the elevator").when(F.col("to_level") > F.col("level"), "Take the stairs up").otherwise("Take the stairs down")
    named = F.when(F.col("link_name").contains("Bridge") | F.col("link_name").contains("Walkway"), F.col("link_name")).otherwise("bridge")
    verb = (
        F.when(F.col("link_kind") == "tunnel", F.concat(F.lit("Take the "), _bold(F.concat(F.lit("tunnel to "), "to"))))
        .when(F.col("link_kind") == "bridge", F.concat(F.lit("Cross the "), _bold(F.concat(named, F.lit(" to "), "to"))))
        .otherwise(F.concat(F.lit("Go through the doorway to "), _bold(F.col("to"))))
    )
    depth = F.when(F.col("link_kind") == "tunnel", F.concat(F.lit(", "), F.col("z_m").cast("string"), F.lit(" m"))).otherwise("")
    unsure = F.when(F.col("verified"), "").otherwise(" (unverified)")
    return (
        F.when(F.col("kind") == "intra", F.concat(F.lit("Walk through "), _bold(F.col("building")), about))
        .when(F.col("kind") == "walk", F.concat(F.lit("Follow the corridor on "), place("level"), about))
        .when(F.col("kind") == "vertical", F.concat(how, F.lit(" to "), place("to_level"), F.lit(".")))
        .when(F.col("kind") == "indoor", F.concat(verb, F.lit(" ("), F.col("length_m").cast("string"), F.lit(" m"), depth, F.lit(")"), unsure, F.lit(".")))
        .otherwise(F.concat(F.lit("Go outside · "), F.col("m").cast("long").cast("string"), F.lit(" m to "), _bold(F.col("to")), F.lit(".")))
    )
