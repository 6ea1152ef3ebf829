"""Sources of files, diffs, manifests and registry answers."""
