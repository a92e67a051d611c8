"""Where tables come from and go to: files, collections, sessions."""
