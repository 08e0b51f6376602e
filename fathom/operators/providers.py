"""Who serves a name's DNS and who hosts it, from its records.

Signatures are suffixes of whole labels, so a value is looked up by its last
two and last three labels in a literal map, in place of a test by each pattern.
ASCII case doesn't count; a trailing dot is a label. Null names and values are
no records; repeated records change nothing; empty tables give no rows.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import guess_apex

#: Suffixes below which a nameserver belongs to a provider, in order; # stands for digits. Fixed values.
NAMESERVERS = (
    ("cloudflare.com", "Cloudflare"),
    ("awsdns-#.com", "AWS Route 53"),
    ("awsdns-#.net", "AWS Route 53"),
    ("awsdns-#.org", "AWS Route 53"),
    ("awsdns-#.co.uk", "AWS Route 53"),
    ("domaincontrol.com", "GoDaddy"),
    ("registrar-servers.com", "Namecheap"),
    ("googledomains.com", "Google Domains"),
    ("dnsimple.com", "DNSimple"),
    ("digitalocean.com", "DigitalOcean"),
    ("name.com", "Name.com"),
    ("dynect.net", "Oracle Dyn"),
    ("ultradns.net", "UltraDNS"),
    ("ultradns.com", "UltraDNS"),
    ("ultradns.org", "UltraDNS"),
    ("vercel-dns.com", "Vercel"),
    ("ns.porkbun.com", "Porkbun"),
    ("bluehost.com", "Bluehost"),
    ("hostgator.com", "HostGator"),
)
#: Suffixes below which an alias belongs to a host, in order. Fixed values.
ALIASES = (
    ("vercel-dns.com", "Vercel"),
    ("netlify.app", "Netlify"),
    ("netlify.com", "Netlify"),
    ("github.io", "GitHub Pages"),
    ("pages.dev", "Cloudflare Pages"),
    ("herokudns.com", "Heroku"),
    ("herokuapp.com", "Heroku"),
    ("myshopify.com", "Shopify"),
    ("onrender.com", "Render"),
    ("up.railway.app", "Railway"),
    ("fly.dev", "Fly.io"),
    ("azurewebsites.net", "Microsoft Azure"),
    ("wixdns.net", "Wix"),
    ("squarespace.com", "Squarespace"),
    ("webflow.io", "Webflow"),
    ("cdn.cloudflare.net", "Cloudflare"),
    ("amazonaws.com", "AWS"),
)
#: Aliases that are also a host's by themselves. Fixed values.
WHOLE = ("netlify.app", "netlify.com")
#: Addresses of hosts. Fixed values.
ADDRESSES = {a: "GitHub Pages" for a in ("185.199.108.153", "185.199.109.153", "185.199.110.153", "185.199.111.153")}


def provider_of(value: Column, signatures: tuple, whole: tuple = ()) -> Column:
    """The provider of the first signature that a value ends in below a dot, or is, if among `whole`; null without one."""
    low = F.translate(value, ascii_uppercase + "#", ascii_lowercase + "?")
    key = F.regexp_replace(low, r"-[0-9]+(?=\.)", "-#")
    order = F.create_map(*[F.lit(x) for k, (suffix, _) in enumerate(signatures) for x in (suffix, k + 1)])
    found = []
    for labels in sorted({suffix.count(".") + 1 for suffix, _ in signatures}):
        end = F.substring_index(key, ".", -labels)
        found.append(F.when((F.length(end) < F.length(key)) | end.isin(*whole), F.try_element_at(order, end)))
    first = F.array_min(F.array(*found))
    return F.try_element_at(F.array(*[F.lit(p) for _, p in signatures]), first)


def detect(hosts: DataFrame, nameservers: DataFrame, aliases: DataFrame, addresses: DataFrame) -> DataFrame:
    """hosts (host) with records of names (name, position, value; addresses without position).

    (host, resolvable, nameserver_provider, cname, hosting_provider), a row for
    each distinct host. Nameservers of the guessed apex count where the host has
    none of its own; the first known one names the provider. The first alias
    names the hosting, else any known address.
    """
    ns = nameservers.filter("name is not null and value is not null").withColumn("p", provider_of(F.col("value"), NAMESERVERS))
    ns = ns.groupBy("name").agg(F.min_by("p", F.when(F.col("p").isNotNull(), F.struct("position", "value"))).alias("p"))
    al = aliases.filter("name is not null and value is not null").groupBy("name").agg(F.min_by("value", F.struct("position", "value")).alias("cname"))
    known = F.create_map(*[F.lit(x) for pair in ADDRESSES.items() for x in pair])
    at = addresses.filter("name is not null and value is not null").groupBy("name").agg(F.min(F.try_element_at(known, F.col("value"))).alias("at"))
    some = lambda t, key, flag: t.withColumnRenamed("name", key).withColumn(flag, F.lit(True))
    j = hosts.select("host").filter("host is not null").distinct().withColumn("apex", guess_apex(F.col("host")))
    j = j.join(some(ns, "host", "own"), "host", "left").join(some(ns.withColumnRenamed("p", "q"), "apex", "above"), "apex", "left")
    j = j.join(some(al, "host", "aliased"), "host", "left").join(some(at, "host", "placed"), "host", "left")
    return j.select(
        "host",
        F.coalesce("own", "above", "aliased", "placed", F.lit(False)).alias("resolvable"),
        F.when(F.col("own"), F.col("p")).otherwise(F.col("q")).alias("nameserver_provider"),
        "cname",
        F.coalesce(provider_of(F.col("cname"), ALIASES, WHOLE), "at").alias("hosting_provider"),
    )
