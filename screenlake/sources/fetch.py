"""Downloads: published files into storage that all executors can read."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from screenlake.sources.feeds import HEAD, WrongContent, _system, wrong_head

AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/126.0 Safari/537.36"
TRIES, WAIT = 4, 2.0


def fetch(spark: SparkSession, url: str, to: str, *, tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> str:
    """Streams ``url`` to the file ``to`` by buffers of 64 kB, and gives ``to`` back.

    Publishers turn away what isn't a browser, so the request names one; redirects are followed. A busy or failing server is
    asked again, after twice the time each turn. WrongContent if it refuses, or sends nothing or a web page in place of
    the file, which then isn't written."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(to)
    for turn in range(tries):
        if turn:
            sleep(wait * 2 ** (turn - 1))
        last = turn == tries - 1
        try:
            connection = jvm.java.net.URI(url).toURL().openConnection()
            connection.setRequestProperty("User-Agent", AGENT)
            connection.setConnectTimeout(30_000)
            connection.setReadTimeout(120_000)
            code = connection.getResponseCode() if url.startswith("http") else 200
            if code == 429 or code >= 500:
                if last:
                    raise WrongContent(f"{url}: status {code}")
                continue
            if code >= 400:
                raise WrongContent(f"{url}: status {code}")
            source = jvm.java.io.BufferedInputStream(connection.getInputStream(), 1 << 16)
            source.mark(2 * HEAD)
            head = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(source, HEAD)))
            if wrong_head(head):
                source.close()
                raise WrongContent(url)
            source.reset()
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, _system(spark, target).create(target, True), 1 << 16, True)
            return to
        except WrongContent:
            raise
        except Exception:  # the connection broke, in one of many ways
            if last:
                raise
    raise WrongContent(url)
