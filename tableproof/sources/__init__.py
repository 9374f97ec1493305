"""What is read and written: manifests, artefacts, change logs, object catalogues, snapshots."""
