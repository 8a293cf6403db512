"""Where tables come from and go to: stored indexes, test collections, fetched pages, the shared folder."""
