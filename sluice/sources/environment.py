"""Options of stores from a mapping of environment names, such as os.environ."""

from __future__ import annotations

from collections.abc import Mapping

#: Names of the environment (fixed values).
ACCOUNT, KEY, SAS = "AZURE_STORAGE_ACCOUNT_NAME", "AZURE_STORAGE_ACCOUNT_KEY", "AZURE_STORAGE_SAS_TOKEN"
TENANT, CLIENT, SECRET = "AZURE_TENANT_ID", "AZURE_CLIENT_ID", "AZURE_CLIENT_SECRET"
#: What Hadoop's file system for the store calls its ways to sign in (fixed values).
_OAUTH = "org.apache.hadoop.fs.azurebfs.oauth2"


def store_options(url: str, names: Mapping[str, str]) -> dict[str, str] | None:
    """Spark's options for the store of a URL, by the first of these that the names have: an account key, a token, a client with its secret, a client alone (a managed identity).

    None for other stores, and if nothing is there. The account is that of the URL (abfs://container@account...), else the one that is named. Names without a value
    count as absent. Values go into the options and nowhere else.
    """
    scheme, found, rest = url.partition("://")
    if not found or scheme not in ("abfs", "abfss", "az"):
        return None
    host = rest.partition("/")[0].partition("@")[2] or (f"{names[ACCOUNT]}.dfs.core.windows.net" if names.get(ACCOUNT) else "")
    if not host:
        return None
    own = lambda *wanted: all(names.get(w) for w in wanted)
    if own(KEY):
        return {f"fs.azure.account.key.{host}": names[KEY]}
    if own(SAS):
        return {f"fs.azure.account.auth.type.{host}": "SAS", f"fs.azure.sas.fixed.token.{host}": names[SAS]}
    oauth = {f"fs.azure.account.auth.type.{host}": "OAuth"}
    if own(TENANT, CLIENT, SECRET):
        oauth[f"fs.azure.account.oauth.provider.type.{host}"] = f"{_OAUTH}.ClientCredsTokenProvider"
        oauth[f"fs.azure.account.oauth2.client.endpoint.{host}"] = f"https://login.microsoftonline.com/{names[TENANT]}/oauth2/token"
        return oauth | {f"fs.azure.account.oauth2.client.id.{host}": names[CLIENT], f"fs.azure.account.oauth2.client.secret.{host}": names[SECRET]}
    if own(CLIENT):
        return oauth | {f"fs.azure.account.oauth.provider.type.{host}": f"{_OAUTH}.MsiTokenProvider", f"fs.azure.account.oauth2.client.id.{host}": names[CLIENT]}
    return None
