"""Which project an app's thread belongs to, and which call was open when another was made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterloom.operators.joins import longest_prefix
from meterloom.operators.sequences import only_open
from meterloom.operators.trees import climbed
from meterloom.plans.registry import query, table


def thread_projects(threads: DataFrame, spawned: DataFrame, projects: DataFrame, roots: DataFrame, assigned: DataFrame, projectless: DataFrame) -> DataFrame:
    """thread, project and resolution of threads (thread, project, cwd): the first that holds of

    1. its own project, if that is known, 2. one that it is assigned to (thread, project; known ones, the least
    of several), 3. the list of projectless threads (thread); 4. for a spawned one (spawned: thread, parent) what
    its root ancestor has by 1 to 3 and 5, if the app knows that thread: inherited, or projectless as
    the root is; 5. the deepest of the roots (root, project) that holds its folder; 6. projectless.

    A chain of parents that leads round in a circle ends where it enters it, and threads of a circle have no ancestor."""
    known = projects.select("project").distinct()
    own = threads.select("thread", F.col("project").alias("own"), "cwd")
    first = assigned.join(known, "project").groupBy("thread").agg(F.min("project").alias("given"))
    listed = projectless.select("thread").distinct().withColumn("listed", F.lit(True))
    held = own.join(known.select(F.col("project").alias("own"), F.lit(True).alias("known")), "own", "left").join(first, "thread", "left").join(listed, "thread", "left")
    said = F.when(F.col("known"), F.struct(F.col("own").alias("project"), F.lit("app_assignment").alias("how"))).when(F.col("given").isNotNull(), F.struct(F.col("given").alias("project"), F.lit("app_assignment").alias("how"))).when(F.col("listed"), F.struct(F.lit(None).cast("string").alias("project"), F.lit("projectless").alias("how")))
    placed = longest_prefix(held.withColumn("said", said), "cwd", roots.select("root", F.col("project").alias("under")), "root", ["under"])
    folder = F.when(F.col("under").isNotNull(), F.struct(F.col("under").alias("project"), F.lit("folder").alias("how")))
    placed = placed.select("thread", "said", folder.alias("folder"))
    nodes = spawned.select("thread", "parent").unionByName(threads.select("thread", F.lit(None).cast(threads.schema["thread"].dataType).alias("parent"))).unionByName(spawned.select(F.col("parent").alias("thread"), F.lit(None).cast(threads.schema["thread"].dataType).alias("parent")))
    top = climbed(nodes, node="thread", parent="parent").where("root <> thread").select("thread", "root")
    above = placed.select(F.col("thread").alias("root"), F.coalesce("said", "folder").alias("theirs"), F.lit(True).alias("there"))
    both = placed.join(top.join(above, "root"), "thread", "left")
    inherited = F.when(F.col("theirs.project").isNotNull(), F.struct(F.col("theirs.project").alias("project"), F.lit("inherited").alias("how")))
    none = F.struct(F.lit(None).cast("string").alias("project"), F.lit("projectless").alias("how"))
    found = F.coalesce("said", F.when(F.col("there"), F.coalesce(inherited, none)), "folder", none)
    return both.select("thread", found.alias("found")).select("thread", F.col("found.project").alias("project"), F.col("found.how").alias("resolution"))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey AS n, 'c' || o_custkey % 20 AS folder, CASE WHEN o_custkey % 11 = 0 THEN 'p' || o_custkey % 37 END AS own, o_orderkey % 23 = 0 AS given, 'p' || o_orderkey % 41 AS gp, o_orderkey % 17 = 0 AS listed FROM orders),
    t AS (SELECT n, CASE WHEN n % 600 = 0 THEN n + 5 WHEN n % 200 = 0 THEN -1 - n WHEN n % 50 > 0 OR n % 3 > 0 THEN n - 1 - CASE WHEN n % 7 = 6 THEN 1 ELSE 0 END END AS p FROM o),
    e AS (SELECT n, p FROM t UNION SELECT p, NULL FROM t WHERE p < 0), c AS (SELECT n AS top, p AS spot FROM e WHERE n % 600 = 0 AND n >= 0 AND p IN (SELECT n FROM e) UNION SELECT c.top, e.p FROM c JOIN e ON e.n = c.spot WHERE e.p IS NOT NULL),
    ring AS (SELECT DISTINCT spot FROM c WHERE top IN (SELECT top FROM c WHERE spot = top)), r AS (SELECT n, n AS root FROM e WHERE p IS NULL OR n IN (SELECT spot FROM ring) UNION ALL SELECT e.n, r.root FROM r JOIN e ON e.p = r.n WHERE e.n NOT IN (SELECT spot FROM ring)),
    s AS (SELECT o.n, r.root, CASE WHEN TRY_CAST(substr(own, 2) AS INT) < 30 THEN {'p': own, 'h': 'app_assignment'} WHEN given AND TRY_CAST(substr(gp, 2) AS INT) < 30 THEN {'p': gp, 'h': 'app_assignment'} WHEN listed THEN {'p': NULL, 'h': 'projectless'} END AS said,
        CASE WHEN TRY_CAST(substr(folder, 2) AS INT) < 12 THEN {'p': CASE WHEN folder = 'c3' THEN 'p1' ELSE 'p' || substr(folder, 2) END, 'h': 'folder'} END AS f FROM o JOIN r USING (n)),
    b AS (SELECT s.n, s.said, s.f, a.n IS NOT NULL AS there, coalesce(a.said, a.f) AS theirs FROM s LEFT JOIN s AS a ON a.n = s.root AND s.root <> s.n),
    z AS (SELECT n, coalesce(said, CASE WHEN there THEN CASE WHEN theirs.p IS NOT NULL THEN {'p': theirs.p, 'h': 'inherited'} ELSE {'p': NULL, 'h': 'projectless'} END END, f, {'p': NULL, 'h': 'projectless'}) AS x FROM b)
    SELECT n AS thread, x.p AS project, x.h AS resolution FROM z""")
def thread_resolution(spark, sf_dir):
    """Orders as threads that spawn each other in chains of up to 200, some round in a circle or from unknown threads."""
    n, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, sf_dir, "orders")
    folder = cust % 20
    project = lambda c: F.concat(F.lit("p"), c.cast("string"))
    threads = orders.select(n.alias("thread"), F.when(cust % 11 == 0, project(cust % 37)).alias("project"), F.concat(F.lit("/w/c"), folder.cast("string"), F.lit("/deep/er")).alias("cwd"))
    parent = F.when(n % 600 == 0, n + 5).when(n % 200 == 0, -1 - n).when((n % 50 > 0) | (n % 3 > 0), n - 1 - F.when(n % 7 == 6, 1).otherwise(0))
    spawned = orders.select(n.alias("thread"), parent.alias("parent")).where("parent IS NOT NULL")
    numbers = orders.select((n % 41).alias("k")).distinct()
    projects = numbers.where("k < 30").select(project(F.col("k")).alias("project"))
    folders = orders.select(folder.alias("k")).distinct().where("k < 12")
    roots = folders.select(F.concat(F.lit("/w/c"), F.col("k").cast("string")).alias("root"), project(F.col("k")).alias("project"))
    roots = roots.unionByName(folders.where("k = 3").select(F.lit("/w/c3").alias("root"), F.lit("p1").alias("project"))).unionByName(folders.where("k = 0").select(F.lit("/w").alias("root"), F.lit(None).cast("string").alias("project")).where("project IS NOT NULL"))
    assigned = orders.where(n % 23 == 0).select(n.alias("thread"), project(n % 41).alias("project"))
    return thread_projects(threads, spawned, projects, roots, assigned, orders.where(n % 17 == 0).select(n.alias("thread")))


@query("""WITH c AS (SELECT user_id, event_id, event_id AS a, event_id + 40 + event_id % 900 AS b FROM events WHERE event_type = 'purchase'), q AS (SELECT user_id, event_id FROM events WHERE event_type <> 'purchase')
    SELECT q.user_id, q.event_id, CASE WHEN count(c.event_id) = 1 THEN any_value('x' || c.event_id) END AS enclosing, count(c.event_id) AS open FROM q LEFT JOIN c ON c.user_id = q.user_id AND c.a < q.event_id AND q.event_id < c.b GROUP BY ALL""")
def enclosing_calls(spark, sf_dir):
    """The wrapper's call that alone was open when another call was made."""
    events, at = table(spark, sf_dir, "events"), F.col("event_id")
    calls = events.where("event_type = 'purchase'").select("user_id", F.concat(F.lit("x"), at).alias("call"), at.alias("opened"), (at + 40 + at % 900).alias("closed"))
    points = events.where("event_type <> 'purchase'").select("user_id", "event_id")
    return only_open(points, calls, ["user_id"], at="event_id", opened="opened", closed="closed", call="call")
