"""Query plans over the test tables, by family."""

from keyloom.plans import bits, data, hashes, keys, lists, sets, strings, zsets

FAMILIES = {"strings": strings, "keys": keys, "bits": bits, "hashes": hashes, "lists": lists, "sets": sets, "zsets": zsets, "data": data}
ALL = [q for family in FAMILIES.values() for q in family.QUERIES]
