"""URLs that a plain pattern accepts and those that are split."""

import pytest
from pyspark.sql import functions as F

from curator.functions import urls


@pytest.mark.parametrize("url, good", [
    ("https://h.example/p?q#f", True), ("http://h", True), ("HTTPS://H:443/", True), ("http://h:65536", False), ("http://u@h/", False), ("http:///p", False),
    ("https://h/a b", False), ("https://h/\n", False), ("https://h\n", False), ("ftp://h", False), ("https://é.example/", True), (None, False)])
def test_plain_urls_need_no_closer_look(one, url, good):
    assert one(urls.is_http_url(F.lit(url).cast("string"))) is good


def test_a_plain_url_is_not_split(one, monkeypatch):
    monkeypatch.setattr(urls, "split_url", lambda c: F.raise_error(F.lit("split")).cast("struct<scheme:string,authority:string,host:string,port:string>"))
    assert one(urls.is_http_url(F.lit("https://h.example/p?q#f"))) is True
