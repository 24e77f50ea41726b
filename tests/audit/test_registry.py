"""The job queue's steps, settings and https upgrades."""

from siteglass.operators import registry


def test_jobs_run_first_in_first_out(spark):
    jobs = spark.createDataFrame([], registry.JOBS)
    jobs = registry.enqueue(jobs, spark.createDataFrame([("b", "s1"), ("a", "s0")], "id string, seed string"))
    jobs = registry.enqueue(jobs, spark.createDataFrame([("a", "x"), ("c", "s2")], "id string, seed string"))
    state = lambda df: {r.id: (r.position, r.status) for r in df.collect()}
    assert state(jobs) == {"a": (1, "queued"), "b": (2, "queued"), "c": (3, "queued")}
    running = registry.claim(jobs)
    assert state(running)["a"] == (1, "running") and state(registry.claim(running))["b"] == (2, "queued")
    assert state(registry.reconcile(running)) == state(jobs)
    done = registry.settle(running, "a", "done")
    assert state(done)["a"][1] == "done" and state(registry.settle(done, "a", "cancelled"))["a"][1] == "done"
    assert state(registry.claim(done))["b"][1] == "running"


def test_meta_and_blobs(spark):
    meta = spark.createDataFrame([("mode", "list"), ("x", "1")], "key string, value string")
    assert {r.key: r.value for r in registry.with_meta(meta, {"mode": "spider", "seeds": "[]"}).collect()} == {"mode": "spider", "x": "1", "seeds": "[]"}
    bodies = spark.createDataFrame([("u", bytearray(b"x"))], "url string, body binary")
    assert registry.blobs(bodies, "html", ".html").first().path == "7b774effe4a349c6dd82ad4f4f21d34c.html"


def test_https_upgrades(spark):
    pages = spark.createDataFrame([("http://a.b.c:80/x",), ("http://b.c/",), ("http://z.own/",), ("http://own/",), ("https://b.c/",)], "url string")
    hsts = spark.createDataFrame([("b.c", True), ("own", False)], "host string, include_subdomains boolean")
    got = {r.url: r.redirect_url for r in registry.https_upgrades(pages, hsts).collect()}
    assert got == {"http://a.b.c:80/x": "https://a.b.c/x", "http://b.c/": "https://b.c/", "http://own/": "https://own/"}
